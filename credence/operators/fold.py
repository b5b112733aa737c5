"""The belief fold for all subject-lines at once.

What can be summed is summed (with partial sums before the shuffle). Only lines with several live claims whose valid times
are all trusted are sorted, to see whether their windows follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.scalars import criticality_name, criticality_rank, currency, instant
from credence.operators.liveness import Instant, is_trusted, with_liveness
from credence.schema import LINE, Tables

CANONICAL = ("okey", "tx_time", "claim_id")


def successions(live: DataFrame, t: Tables) -> DataFrame:
    """Lines whose live claims (more than one, all trusted) hold windows that don't overlap.

    In order of start and end, all windows are apart if neighbours are. A window that ends before it starts is apart from all
    others of its kind, and clashes only with a window that reaches from before its end to after its start; if the others
    are apart, that can only be the last one that starts before its end. So one pass in order sees every clash.
    """
    several = live.groupBy(*LINE).agg(F.count("*").alias("n"), F.bool_and(is_trusted(t.config)).alias("all")).where((F.col("n") > 1) & F.col("all"))
    rows = live.select(*LINE, "valid_start", "valid_end", "claim_id").join(several.select(*LINE), list(LINE))
    bent = F.coalesce(F.col("valid_end") < F.col("valid_start"), F.lit(False))
    rows = rows.withColumn("bent", bent).withColumn("key", F.when(F.col("bent"), F.col("valid_end")).otherwise(F.col("valid_start")))
    rows = rows.withColumn("straight", F.when(~F.col("bent"), F.struct("valid_start", "valid_end")))
    over = f"OVER (PARTITION BY {', '.join(LINE)} ORDER BY key, NOT bent, valid_end NULLS LAST, claim_id)"
    rows = rows.withColumn("next", F.expr(f"lead(straight) IGNORE NULLS {over}")).withColumn("before", F.expr(f"lag(straight) IGNORE NULLS {over}"))
    reaches = F.col("before").isNotNull() & (F.col("before.valid_end").isNull() | (F.col("before.valid_end") > F.col("valid_start")))
    runs_on = F.col("next").isNotNull() & ~F.coalesce(F.col("valid_end") <= F.col("next.valid_start"), F.lit(False))
    return rows.groupBy(*LINE).agg(F.bool_or(F.when(F.col("bent"), reaches).otherwise(runs_on)).alias("clash")).where(~F.col("clash")).select(*LINE)


def contains(at: Column) -> Column:
    return (F.col("valid_start") <= at) & (F.col("valid_end").isNull() | (at < F.col("valid_end")))


def selected_claims(t: Tables, as_of: Instant, valid_at: Instant | None = None) -> DataFrame:
    """Live claims; of successions only the one whose window holds the instant."""
    live = with_liveness(t, as_of).where("live")
    follow = successions(live, t).withColumn("succession", F.lit(True))
    at = instant(valid_at if valid_at is not None else as_of)
    joined = live.join(follow, list(LINE), "left").withColumn("succession", F.coalesce("succession", F.lit(False)))
    return joined.where(~F.col("succession") | contains(at))


def _rfc3339(at: Column) -> Column:
    """An instant in UTC with its offset; fractions of a second as far as there are any, in threes."""
    micros = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    tail = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(at, ".SSS")).otherwise(F.date_format(at, ".SSSSSS"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("+00:00"))


#: Columns of a belief that a table of claims may lack.
OPTIONAL = {"value_confidence": "float", "start_granularity": "string", "end_granularity": "string"}


def _belief(t: Tables) -> Column:
    """A claim as a belief: when it was last refreshed is when it was written, and nothing corroborates it."""
    more = [F.col(c) if c in t.claims.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    return F.struct("claim_id", "value_json", "provenance", "tx_time", "valid_start", "valid_end", *more, "criticality", F.col("tx_time").alias("last_refreshed_at"), F.lit(0).alias("corroboration_count"))


def beliefs(t: Tables, as_of: Instant, valid_at: Instant | None = None, now: Instant | None = None) -> DataFrame:
    """One row per line known at as_of: status, primary belief, counts, currency, staleness, criticality and markers."""
    config, clock = t.config, instant(now if now is not None else as_of)
    key = F.struct(*CANONICAL)
    folded = selected_claims(t, as_of, valid_at).groupBy(*LINE).agg(
        F.count("*").alias("n_live"),
        F.count_if(F.col("cardinality") == "Functional").alias("n_functional"),
        F.bool_or(F.col("cardinality") != "SetValued").alias("any_not_set"),
        F.bool_or(F.coalesce(F.col("disposition") == "Contested", F.lit(False))).alias("contested"),
        F.bool_or(F.coalesce("pending_review", F.lit(False))).alias("any_review"),
        F.bool_or(F.col("provenance") == "RecallReEntry").alias("any_recall"),
        F.bool_or(F.col("derivation_depth") > config.derivation_depth_cap_for_currency_boost).alias("any_deep"),
        F.max(criticality_rank(F.col("criticality"))).alias("rank"),
        F.min_by(_belief(t), key).alias("first"),
    )
    lines = t.claims.where(F.col("tx_time") <= instant(as_of)).select(*LINE).distinct()
    b = lines.join(folded, list(LINE), "left").withColumn("n_live", F.coalesce("n_live", F.lit(0)))
    conflict = F.coalesce((F.col("n_functional") > 1) | ((F.col("n_live") > 1) & F.col("any_not_set")), F.lit(False))
    b = b.withColumn("has_conflict", conflict).withColumn("contested", F.coalesce("contested", F.lit(False)))
    sole = (F.col("n_live") == 1) & ~F.col("has_conflict")
    unknown = F.col("first.valid_start").isNull() & F.col("first.valid_end").isNull()
    status = (
        F.when(F.col("n_live") == 0, "NoBelief").when(F.col("contested") | F.col("has_conflict"), "Contested")
        .when(F.col("n_live") == 1, F.when(unknown, "TimingUncertain").otherwise("Resolved")).otherwise("Resolved")
    )
    state = F.when(F.col("n_live") == 0, "Decayed").otherwise(currency(F.col("first.tx_time"), clock, config.aging_unconfirmed_threshold_days, config.decayed_threshold_days))
    b = b.withColumn("currency", state).withColumn("primary", F.when(sole, F.col("first")))
    stale = F.when(F.col("n_live") == 0, True).otherwise(F.col("primary").isNotNull() & (F.col("currency") == "Decayed"))
    reason = (
        F.when(F.col("n_live") == 0, "no live claim")
        .when(F.col("primary").isNull(), F.lit(None))
        .when(F.col("currency") == "Decayed", F.concat(F.lit("currency decayed: last refreshed at "), _rfc3339(F.col("primary.tx_time"))))
        .when(F.col("currency") == "AgingUnconfirmed", "aging unconfirmed: asserted long ago, not yet reconfirmed")
    )
    mark = lambda flag, name: F.when(F.coalesce(flag, F.lit(False)), F.lit(name))
    markers = F.array_compact(F.array(mark(F.col("contested") | F.col("has_conflict"), "Contested"), mark(F.col("any_review"), "PendingReview"), mark(F.col("any_recall"), "RecallTainted"), mark(F.col("any_deep"), "LowDerivationAnchor")))
    return b.select(
        *LINE, status.alias("status"), F.col("n_live").cast("long").alias("n_live"), "has_conflict", "contested", "primary", "first", "currency", stale.alias("is_stale"), reason.alias("stale_reason"),
        criticality_name(F.coalesce("rank", F.lit(0))).alias("criticality"), markers.alias("markers"),
    )


def alternatives(t: Tables, as_of: Instant, valid_at: Instant | None = None) -> DataFrame:
    """The live claims of lines without a primary belief, as rows with their canonical place."""
    rows = selected_claims(t, as_of, valid_at)
    stats = rows.groupBy(*LINE).agg(F.count("*").alias("n_live"))
    place = F.row_number().over(Window.partitionBy(*LINE).orderBy(*CANONICAL))
    return rows.join(stats.where("n_live > 1"), list(LINE)).withColumn("place", place)
