"""Which claims are live at an instant of transaction time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.scalars import instant, threshold
from credence.schema import NON_LIVE, Config, Tables

Instant = dt.datetime | str


def latest_disposition(ledger: DataFrame, as_of: Instant | None = None) -> DataFrame:
    """Per claim: its last disposition, and whether it was ever flagged for review. Partial sums before the shuffle."""
    rows = ledger if as_of is None else ledger.where(F.col("recorded_at") <= instant(as_of))
    return rows.groupBy("claim_id").agg(
        F.max_by("disposition", F.struct("recorded_at", "stream_seq")).alias("disposition"),
        F.bool_or((F.col("event_kind") == "DependentFlaggedPendingReview") & (F.col("disposition") == "PendingReview")).alias("pending_review"),
    )


def assertion_state(assertions: DataFrame, as_of: Instant) -> DataFrame:
    """Per claim: the last assertion in effect. Each one sets the state, so that replaying them is taking the last."""
    at = instant(as_of)
    rows = assertions.where((F.col("asserted_at") <= at) & (F.col("effective_at") <= at))
    return rows.groupBy(F.col("target_claim_id").alias("claim_id")).agg(F.max_by("kind", F.struct("asserted_at", "assertion_id")).alias("last_kind"))


def order_key(config: Config) -> Column:
    """Start of valid time where it is trusted, else transaction time."""
    trusted = F.col("valid_time_confidence") >= threshold(config.valid_time_confidence_threshold)
    return F.when(trusted, F.coalesce("valid_start", "tx_time")).otherwise(F.col("tx_time"))


def is_trusted(config: Config) -> Column:
    return (F.col("valid_time_confidence") >= threshold(config.valid_time_confidence_threshold)) & F.col("valid_start").isNotNull()


def with_liveness(t: Tables, as_of: Instant) -> DataFrame:
    """Claims known at as_of with okey, disposition, pending_review, last_kind and live."""
    claims = t.claims.where(F.col("tx_time") <= instant(as_of)).withColumn("okey", order_key(t.config))
    joined = claims.join(latest_disposition(t.ledger, as_of), "claim_id", "left").join(assertion_state(t.assertions, as_of), "claim_id", "left")
    return joined.withColumn("live", (F.coalesce("last_kind", F.lit("Reopen")) == "Reopen") & ~F.coalesce("disposition", F.lit("")).isin(*NON_LIVE))
