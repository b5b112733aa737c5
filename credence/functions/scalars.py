"""Scalar functions as columns."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.schema import CRITICALITIES, GRANULARITIES


def instant(value: dt.datetime | str) -> Column:
    """A literal on the time axis: UTC without zone."""
    return F.lit(str(value).replace("T", " ").removesuffix("Z").removesuffix("+00:00")).cast("timestamp_ntz")


def threshold(value: float) -> Column:
    """Confidences are floats; a double literal would miss values exactly at the threshold."""
    return F.lit(value).cast("float")


def parse_valid_date(text: Column) -> Column:
    """struct(at, granularity) of a full instant, YYYY-MM-DD, YYYY-MM or YYYY; null if none fits."""
    t = F.trim(text)
    full = F.try_to_timestamp(F.regexp_replace(t, "[zZ]$", "+00:00"))
    of = lambda pattern, tail, name: F.when(
        t.rlike(pattern), F.struct(F.to_timestamp_ntz(F.concat(t, F.lit(tail)), F.lit("yyyy-MM-dd")).alias("at"), F.lit(name).alias("granularity"))
    )
    valid = lambda tail: F.try_to_date(F.concat(t, F.lit(tail)), "yyyy-MM-dd").isNotNull()
    is_instant = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([zZ]|[+-]\d{2}:\d{2})$")
    return (
        F.when(is_instant & full.isNotNull(), F.struct(F.to_utc_timestamp(full, F.current_timezone()).cast("timestamp_ntz").alias("at"), F.lit("instant").alias("granularity")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & valid(""), of("", "", "day"))
        .when(t.rlike(r"^\d{4}-\d{2}$") & valid("-01"), of("", "-01", "month"))
        .when(t.rlike(r"^[0-9]{4}$") & valid("-01-01"), of("", "-01-01", "year"))
    )


def format_valid_date(at: Column, granularity: Column) -> Column:
    """Year, month or day text of an endpoint; instants and unknown granularities show the day."""
    return F.when(granularity == "year", F.date_format(at, "yyyy")).when(granularity == "month", F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def shown_endpoint(at: dt.datetime | None, granularity: str | None) -> str | None:
    """format_valid_date() of one value."""
    return None if at is None else at.strftime({"year": "%Y", "month": "%Y-%m"}.get(granularity, "%Y-%m-%d"))


def known_granularity(text: Column) -> Column:
    return F.when(text.isin(*GRANULARITIES), text)


def whole_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(F.ceil(micros / 1_000_000)).cast("long")


def currency(refreshed: Column, now: Column, aging_days: int, decayed_days: int) -> Column:
    age = whole_seconds(refreshed, now)
    return F.when(age < aging_days * 86400, "Fresh").when(age < decayed_days * 86400, "AgingUnconfirmed").otherwise("Decayed")


def criticality_rank(text: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(CRITICALITIES):
        out = F.when(text == name, i).otherwise(out)
    return out


def criticality_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CRITICALITIES)), rank + 1)


def provenance_display(text: Column) -> Column:
    return F.when(text.startswith("External_"), F.concat(F.lit("External/"), F.substring(text, 10, 64))).when(text.isin("RecallReEntry", "ModelDerived"), text).otherwise("Unknown")


def json_display(value: Column) -> Column:
    """A JSON string shows its content, any other value its compact text."""
    return F.when(F.substring(value, 1, 1) == '"', F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def canonical_json(value: Any) -> str:
    """One text for each JSON value: sorted keys, no white space, whole and fractional numbers apart."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


STATUS_REASONS = {
    "Contested": "two or more external claims contradict each other and nothing has decided between them",
    "PendingConflict": "a conflict is recorded and waits for evidence",
    "PendingReview": "a claim it depends on was superseded",
    "Quarantined": "its times are incoherent or it came in a burst; kept for audit",
    "QueuedForAdjudication": "it would overturn a belief and waits for a verdict",
}
