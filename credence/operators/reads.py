"""Scans, subject facts, history, audit, lineage and the adjudication queue, as set-based DataFrames.

Point reads are these DataFrames with a filter; Catalyst pushes the filter to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.scalars import format_valid_date, instant, json_display, provenance_display
from credence.operators.fold import CANONICAL, beliefs, selected_claims
from credence.operators.liveness import Instant, latest_disposition, order_key
from credence.schema import LINE, LINEAGE_LEVELS, Tables
from credence.sources.staging import stage


def subject_line(t: Tables, agent: str, subject: str, predicate: str, as_of: Instant | None = None) -> DataFrame:
    rows = t.claims.where((F.col("agent_id") == agent) & (F.col("subject") == subject) & (F.col("predicate") == predicate))
    return (rows if as_of is None else rows.where(F.col("tx_time") <= instant(as_of))).orderBy("tx_time", "claim_id")


def assertions_of(t: Tables) -> DataFrame:
    """Assertions of every claim with their place in the order in which they were made."""
    place = F.row_number().over(Window.partitionBy("target_claim_id").orderBy("asserted_at", "assertion_id"))
    return t.assertions.withColumn("place", place)


def ledger_page(t: Tables, start: Instant | None, limit: int, agent: str | None = None) -> DataFrame:
    """The oldest rows from an instant on; a top-k, so `limit` is the feature."""
    rows = t.ledger if agent is None else t.ledger.where(F.col("agent_id") == agent)
    rows = rows if start is None else rows.where(F.col("recorded_at") >= instant(start))
    return rows.orderBy("recorded_at", "stream_seq", "entry_id").limit(limit)


def audit(t: Tables, limit: int, claim_id: str | None = None, start: Instant | None = None, agent: str | None = None) -> DataFrame:
    """The page first, then the claim, then newest first."""
    rows = ledger_page(t, start, limit, agent)
    rows = rows if claim_id is None else rows.where(F.col("claim_id") == claim_id)
    return rows.orderBy(F.desc("recorded_at"), F.desc("stream_seq"), F.desc("entry_id"))


def ledger_for_claims(t: Tables, claim_ids: DataFrame, as_of: Instant | None = None) -> DataFrame:
    rows = t.ledger if as_of is None else t.ledger.where(F.col("recorded_at") <= instant(as_of))
    return rows.join(claim_ids.select("claim_id"), "claim_id", "left_semi")


def edges_of(t: Tables) -> DataFrame:
    """Edges of every claim, at either end."""
    ends = F.array_distinct(F.array("from_claim_id", "to_claim_id"))
    return t.edges.select(F.explode(ends).alias("claim_id"), "*")


def injected_claims(t: Tables) -> DataFrame:
    rows = t.ledger.where(F.col("event_kind") == "ServedAsInjected")
    return rows.groupBy("agent_id", "claim_id").agg(F.min("recorded_at").alias("first_served"))


def predicates(t: Tables, as_of: Instant | None = None) -> DataFrame:
    rows = t.claims if as_of is None else t.claims.where(F.col("tx_time") <= instant(as_of))
    return rows.select(*LINE).distinct()


def lineage(edges: DataFrame, roots: DataFrame, levels: int = LINEAGE_LEVELS) -> DataFrame:
    """root, edge and depth of the DerivedFrom ancestry of every root; paths repeat, cycles end at the last level."""
    steps = edges.where(F.col("edge_kind") == "DerivedFrom").select("agent_id", "edge_id", "from_claim_id", "to_claim_id", "created_at")
    steps = stage(steps, "lineage-steps")
    front = roots.select(F.col("claim_id").alias("root"), F.col("claim_id").alias("from_claim_id"), "agent_id")
    found = None
    for depth in range(1, levels + 1):
        level = stage(front.join(steps, ["agent_id", "from_claim_id"]).withColumn("depth", F.lit(depth)), "lineage-level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        front = level.select("root", F.col("to_claim_id").alias("from_claim_id"), "agent_id")
    empty = front.join(steps, ["agent_id", "from_claim_id"]).withColumn("depth", F.lit(1)).where(F.lit(False))
    return (empty if found is None else found).select("agent_id", "root", "edge_id", "from_claim_id", "to_claim_id", "depth", "created_at")


def pending_now(t: Tables) -> DataFrame:
    """The last status of each handle."""
    first = t.pending.groupBy("handle_id").agg(F.max_by("status", "seq").alias("status"), F.min_by(F.struct("agent_id", "subject", "predicate", "challenger_claim_id", "incumbent_claim_id", "queued_at", "expires_at"), "seq").alias("row"))
    return first.select("handle_id", "row.*", "status")


def list_pending(t: Tables, agent: str | None = None) -> DataFrame:
    rows = pending_now(t).where(F.col("status") == "pending")
    return rows if agent is None else rows.where(F.col("agent_id") == agent)


def list_expired(t: Tables, now: Instant) -> DataFrame:
    return list_pending(t).where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= instant(now)))


def incumbents(t: Tables) -> DataFrame:
    """Per line the claim last recorded as CommittedCheap, by its latest entry."""
    last = t.ledger.groupBy("claim_id").agg(F.max_by("disposition", F.struct("recorded_at", "stream_seq")).alias("disposition"), F.max("recorded_at").alias("recorded_at"))
    rows = t.claims.select(*LINE, "claim_id").join(last.where(F.col("disposition") == "CommittedCheap"), "claim_id")
    return rows.groupBy(*LINE).agg(F.max_by("claim_id", F.struct("recorded_at", "claim_id")).alias("incumbent_claim_id"))


def orphans(t: Tables) -> DataFrame:
    """Claims left queued without a pending row, with their line's incumbent or 'unknown'."""
    queued = latest_disposition(t.ledger).where(F.col("disposition") == "QueuedForAdjudication").select("claim_id")
    rows = t.claims.select(*LINE, "claim_id").join(queued, "claim_id").join(t.pending.select(F.col("challenger_claim_id").alias("claim_id")), "claim_id", "left_anti")
    return rows.join(incumbents(t), list(LINE), "left").withColumn("incumbent_claim_id", F.coalesce("incumbent_claim_id", F.lit("unknown")))


def history(t: Tables, now: Instant) -> DataFrame:
    """All claims of every line in canonical order: when each took over, until when, and whether it is current."""
    order = Window.partitionBy(*LINE).orderBy(*CANONICAL)
    current = selected_claims(t, now).select("claim_id", F.lit("Current").alias("status"))
    rows = t.claims.withColumn("okey", order_key(t.config)).withColumn("valid_until", F.lead("okey").over(order)).withColumn("place", F.row_number().over(order))
    return rows.join(current, "claim_id", "left").withColumn("status", F.coalesce("status", F.lit("Superseded"))).withColumn("provenance_display", provenance_display(F.col("provenance")))


def subject_facts(t: Tables, as_of: Instant, valid_at: Instant | None = None, now: Instant | None = None) -> DataFrame:
    """One row per predicate of every subject; without a primary belief the first alternative stands in."""
    shown: Column = F.coalesce("primary", "first")
    b = beliefs(t, as_of, valid_at, now).withColumn("shown", shown)
    return b.select(
        *LINE, F.when(F.col("status") == "Conflict", "Contested").otherwise(F.col("status")).alias("status"), F.col("shown.claim_id").alias("claim_id"),
        json_display(F.col("shown.value_json")).alias("value"), F.col("shown.value_confidence").alias("confidence"), format_valid_date(F.col("primary.valid_start"), F.col("primary.start_granularity")).alias("valid_from_display"),
        format_valid_date(F.col("primary.valid_end"), F.col("primary.end_granularity")).alias("valid_until_display"), F.when(F.col("shown").isNull(), "none").otherwise(provenance_display(F.col("shown.provenance"))).alias("provenance"), "currency",
    )


def sequence_numbers(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Gapless numbers from 1 within a key, without gathering a key in one task.

    bucket must rise with the order; numbers run within a bucket and start at the sum of the buckets before it.
    """
    b = rows.withColumn("__bucket", bucket)
    sums = b.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(key, "__bucket", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order))
    return b.withColumn("__place", place).join(starts, [key, "__bucket"]).withColumn("sequence", (F.col("__start") + F.col("__place")).cast("long")).drop("__bucket", "__n", "__start", "__place")
