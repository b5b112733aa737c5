"""Reconciliation, verdicts, expiry and cascades over whole tables: each gives the rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.scalars import instant
from credence.operators.fold import CANONICAL, selected_claims
from credence.operators.gate import against_first
from credence.operators.liveness import Instant, latest_disposition
from credence.operators.reads import list_expired, list_pending, orphans
from credence.schema import Tables


def reconcile(t: Tables, now: Instant, lines: DataFrame | None = None, oracle_present: bool = False) -> DataFrame:
    """Every live claim against the first live claim of its line. heavy: it supersedes that one; escalated: it counts."""
    live = selected_claims(t, now)
    live = live if lines is None else live.join(lines, ["agent_id", "subject", "predicate"], "left_semi")
    rows = against_first(live, list(CANONICAL), t.config, oracle_present=oracle_present)
    heavy = F.col("route") == "HeavyPath"
    return rows.withColumn("escalated", heavy).withColumn("supersedes", F.when(heavy & (F.col("incumbent.claim_id") != F.col("claim_id")), F.col("incumbent.claim_id")))


def dependents(t: Tables, superseded: DataFrame) -> DataFrame:
    """superseded: claim_id, overturning. Distinct direct claims that depend on each; no further walk."""
    edges = t.edges.where(F.col("edge_kind") == "DependsOn").select(F.col("to_claim_id").alias("claim_id"), F.col("from_claim_id").alias("dependent"), "agent_id")
    return edges.join(superseded, "claim_id").select("agent_id", "claim_id", "overturning", "dependent").distinct()


def apply_verdicts(t: Tables, verdicts: DataFrame, now: Instant) -> tuple[DataFrame, DataFrame]:
    """verdicts: handle_id, verdict. Ledger rows (claim_id, event_kind, disposition) and Bound assertions to append.

    Handles that aren't pending, have expired, or whose challenger is no longer queued are left out.
    """
    open_ = list_pending(t).where(F.col("expires_at").isNull() | (F.col("expires_at") > instant(now)))
    queued = latest_disposition(t.ledger).where(F.col("disposition") == "QueuedForAdjudication").select(F.col("claim_id").alias("challenger_claim_id"))
    rows = open_.join(verdicts, "handle_id").join(queued, "challenger_claim_id", "left_semi")
    entry = lambda claim, kind, disposition: F.struct(F.col(claim).alias("claim_id"), F.lit(kind).alias("event_kind"), F.lit(disposition).alias("disposition"))
    moves = (
        F.when(F.col("verdict") == "Affirm", F.array(entry("challenger_claim_id", "AdjudicationResolved", "CommittedCheap"), entry("incumbent_claim_id", "ValidityAsserted", "Superseded")))
        .when(F.col("verdict") == "Deny", F.array(entry("challenger_claim_id", "ValidityAsserted", "Superseded")))
        .otherwise(F.array(entry("challenger_claim_id", "AdjudicationResolved", "Contested"), entry("incumbent_claim_id", "AdjudicationResolved", "Contested")))
    )
    entries = rows.select("handle_id", "agent_id", F.explode(moves).alias("e"), F.col("challenger_claim_id"), F.col("incumbent_claim_id")).select("handle_id", "agent_id", "e.*", F.when(F.col("e.claim_id") == F.col("incumbent_claim_id"), F.col("challenger_claim_id")).otherwise(F.col("incumbent_claim_id")).alias("overturning"))
    bounds = entries.where(F.col("disposition") == "Superseded")
    flagged = dependents(t, bounds.select("claim_id", "overturning")).select(F.lit(None).cast("string").alias("handle_id"), "agent_id", F.col("dependent").alias("claim_id"), F.lit("DependentFlaggedPendingReview").alias("event_kind"), F.lit("PendingReview").alias("disposition"))
    at = instant(now).alias("recorded_at")
    ledger = entries.select("handle_id", "agent_id", "claim_id", "event_kind", "disposition").unionByName(flagged).select("*", at)
    return ledger, bounds.select("agent_id", F.col("claim_id").alias("target_claim_id"), F.lit("Bound").alias("kind"), instant(now).alias("effective_at"), instant(now).alias("asserted_at"))


def sweep(t: Tables, now: Instant) -> DataFrame:
    """Expired and orphaned challengers that are still queued go back to Contested."""
    queued = latest_disposition(t.ledger).where(F.col("disposition") == "QueuedForAdjudication").select("claim_id")
    late = list_expired(t, now).select("agent_id", F.col("challenger_claim_id").alias("claim_id"), "handle_id", F.lit("expired").alias("cause"))
    lost = orphans(t).select("agent_id", "claim_id", F.lit(None).cast("string").alias("handle_id"), F.lit("orphaned").alias("cause"))
    both = late.join(queued, "claim_id", "left_semi").unionByName(lost)
    return both.select("agent_id", "claim_id", "handle_id", "cause", F.lit("AdjudicationExpired").alias("event_kind"), F.lit("Contested").alias("disposition"))
