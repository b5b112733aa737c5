"""Registered queries over the claim tables derived from `events` and `orders`; results are flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import scalars
from credence.operators import adjudication, fold, gate, liveness, reads
from credence.schema import LINE, Tables
from credence.sources.fixtures import AS_OF, NOW, VALID_AT, tables
from credence.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
LIMIT = 1000
_found: dict[str, Query] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _found[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


@query
def subject_line_scan(t):
    place = F.row_number().over(Window.partitionBy(*LINE).orderBy("tx_time", "claim_id"))
    return t.claims.select(*LINE, "claim_id", "value_json", "tx_time", place.cast("long").alias("place"))


@query
def subject_line_as_of(t):
    return t.claims.where(F.col("tx_time") <= scalars.instant(AS_OF)).select(*LINE, "claim_id", "tx_time")


@query
def claim_lookup(t):
    return t.claims.select("claim_id", "agent_id", "value_json", "provenance", "criticality", "valid_start", "valid_end")


@query
def latest_disposition(t):
    return liveness.latest_disposition(t.ledger)


@query
def latest_disposition_as_of(t):
    return liveness.latest_disposition(t.ledger, AS_OF)


@query
def assertions_in_order(t):
    return reads.assertions_of(t).select("assertion_id", "target_claim_id", "kind", F.col("place").cast("long").alias("place"))


@query
def assertion_liveness(t):
    return liveness.assertion_state(t.assertions, AS_OF)


@query
def live_claims(t):
    return liveness.with_liveness(t, AS_OF).select("claim_id", "okey", "live")


@query
def succession_detect(t):
    return fold.successions(liveness.with_liveness(t, NOW).where("live"), t)


@query
def valid_at_select(t):
    return fold.selected_claims(t, NOW, VALID_AT).select(*LINE, "claim_id", "succession")


def _flat(b: DataFrame) -> DataFrame:
    return b.select(*LINE, "status", "n_live", "has_conflict", F.col("primary.claim_id").alias("primary_claim"), F.col("primary.value_json").alias("primary_value"), F.col("first.claim_id").alias("first_claim"))


@query
def belief_current(t):
    return _flat(fold.beliefs(t, NOW))


@query
def belief_as_of(t):
    return _flat(fold.beliefs(t, AS_OF, now=NOW))


@query
def belief_valid_at(t):
    return _flat(fold.beliefs(t, NOW, VALID_AT))


@query
def belief_bitemporal(t):
    return _flat(fold.beliefs(t, "2000-01-01 00:00:00", VALID_AT, NOW))


@query
def belief_currency(t):
    return fold.beliefs(t, AS_OF, now=NOW).select(*LINE, "currency", "criticality")


@query
def belief_staleness(t):
    return fold.beliefs(t, NOW).select(*LINE, "is_stale", "stale_reason")


@query
def belief_markers(t):
    return fold.beliefs(t, NOW).select(*LINE, F.array_join("markers", ",").alias("markers"))


@query
def belief_set_valued(t):
    return fold.beliefs(t, NOW).where("status = 'Resolved' and n_live > 1").select(*LINE, "n_live")


@query
def belief_alternatives(t):
    return fold.alternatives(t, NOW).select(*LINE, "claim_id", F.col("place").cast("long").alias("place"))


@query
def subject_facts(t):
    return reads.subject_facts(t, NOW)


@query
def subject_facts_as_of(t):
    return reads.subject_facts(t, AS_OF, VALID_AT, NOW)


@query
def predicates_distinct(t):
    return reads.predicates(t, AS_OF)


@query
def history_timeline(t):
    return reads.history(t, NOW).select(*LINE, "claim_id", "valid_start", "valid_until", "status", "provenance_display", F.col("place").cast("long").alias("place"))


@query
def history_current(t):
    rows = reads.history(t, NOW).where("status = 'Current'")
    return rows.groupBy(*LINE).agg(F.min_by("claim_id", "place").alias("claim_id"))


@query
def audit_ledger(t):
    return reads.audit(t, LIMIT, start="2024-01-05 00:00:00").select("entry_id", "agent_id", "claim_id", "event_kind", "disposition", "recorded_at")


@query
def audit_by_claim(t):
    return t.ledger.groupBy("claim_id").agg(F.count("*").alias("n"), F.max("recorded_at").alias("last"))


@query
def ledger_for_claims_semi(t):
    live = liveness.with_liveness(t, AS_OF).where("live").select("claim_id")
    return reads.ledger_for_claims(t, live, AS_OF).select("entry_id", "claim_id", "event_kind", "recorded_at")


@query
def injected_claims(t):
    return reads.injected_claims(t)


@query
def edges_for_claim(t):
    return reads.edges_of(t).select("claim_id", "edge_id", "edge_kind", "from_claim_id", "to_claim_id", "created_at")


@query
def lineage_recursive(t):
    return reads.lineage(t.edges, t.claims.select("claim_id", "agent_id")).select("root", "edge_id", "to_claim_id", F.col("depth").cast("long").alias("depth"))


@query
def dependents_cascade(t):
    gone = liveness.latest_disposition(t.ledger).where("disposition = 'Superseded'").select("claim_id", F.lit("").alias("overturning"))
    return adjudication.dependents(t, gone).select("agent_id", "claim_id", "dependent")


@query
def pending_list(t):
    return reads.list_pending(t).select("handle_id", *LINE, "challenger_claim_id", "incumbent_claim_id", "queued_at", "expires_at")


@query
def pending_expired(t):
    return reads.list_expired(t, AS_OF).select("handle_id", "expires_at")


@query
def orphans_anti_join(t):
    return reads.orphans(t).select(*LINE, "claim_id", "incumbent_claim_id")


@query
def incumbent_top1(t):
    return reads.incumbents(t)


def _classified(t, scope, oracle_present=False):
    """Every claim against the first other claim of its scope."""
    superseded = liveness.latest_disposition(t.ledger).where("disposition = 'Superseded'")
    return gate.against_others(gate.superseded_parents(t, superseded), scope, ["tx_time", "claim_id"], t.config, oracle_present)


@query
def gate_decisions(t):
    return _classified(t, list(LINE)).select("claim_id", "conflict_type", "route", F.col("decided").alias("disposition"))


@query
def gate_decisions_with_oracle(t):
    return _classified(t, list(LINE), True).select("claim_id", "route", F.col("decided").alias("disposition"))


@query
def conflict_classification(t):
    return _classified(t, ["agent_id", "subject"]).select("claim_id", "agent_id", "conflict_type", F.col("incumbent.claim_id").alias("incumbent_claim_id"))


@query
def firewall_verdicts(t):
    served = reads.injected_claims(t).groupBy("agent_id").agg(F.min_by("claim_id", F.struct("first_served", "claim_id")).alias("injected"))
    rows = t.claims.join(served, "agent_id", "left").withColumn("burst", F.when(F.col("n") % 97 == 0, 12).otherwise(F.col("n") % 10))
    return rows.select("claim_id", gate.firewall(t.config, F.col("burst"), F.col("injected")).alias("f")).select("claim_id", "f.verdict", "f.target")


@query
def temporal_coherence(t):
    return t.claims.select("claim_id", F.coalesce(gate.incoherent(t.config), F.lit(False)).alias("incoherent"), (F.col("valid_start").isNull() & F.col("valid_end").isNull()).alias("unknown_times"))


@query
def ingest_replay(t):
    return gate.replay_without_times(t).select("claim_id", "conflict_type", "route", F.col("decided").alias("disposition"), F.col("incumbent.claim_id").alias("incumbent_claim_id"))


@query
def ingest_replay_timed(t):
    """All claims, with their valid times, as one batch into a store that holds only what was served before."""
    fresh = ingest.known_targets(t, t.claims).where("known is null").drop("known")
    none = lambda df: df.where(F.lit(False))
    store = Tables(none(t.claims), none(t.assertions), none(t.ledger), none(t.edges), none(t.pending), t.config)
    return ingest.replay(store, fresh, False)


@query
def pending_any_status(t):
    return reads.pending_now(t).select("handle_id", "status", "challenger_claim_id", "incumbent_claim_id", "queued_at")


@query
def belief_slots(t):
    """Beliefs with their windows as text and what goes with them."""
    p = lambda c: F.col(f"primary.{c}")
    shown = lambda end, kind: scalars.format_valid_date(p(end), p(kind))
    return fold.beliefs(t, NOW).select(
        *LINE, p("claim_id").alias("claim_id"), p("value_confidence").alias("confidence"), shown("valid_start", "start_granularity").alias("valid_from_display"), shown("valid_end", "end_granularity").alias("valid_until_display"),
        p("last_refreshed_at").alias("last_refreshed_at"), F.col("primary.corroboration_count").cast("long").alias("corroboration_count"),
    )


@query
def reconcile_outcomes(t):
    return adjudication.reconcile(t, NOW).select("claim_id", "route", F.col("decided").alias("disposition"), "escalated", "supersedes")


@query
def verdict_apply(t):
    kind = F.element_at(F.array(F.lit("Affirm"), F.lit("Deny"), F.lit("Unknown")), F.ascii("handle_id") % 3 + 1)
    verdicts = reads.list_pending(t).select("handle_id", kind.alias("verdict"))
    ledger, _ = adjudication.apply_verdicts(t, verdicts, AS_OF)
    return ledger.select("agent_id", "claim_id", "event_kind", "disposition")


@query
def sweep_outcomes(t):
    return adjudication.sweep(t, NOW).select("claim_id", "cause", "event_kind", "disposition")


@query
def overlap_pairs(t):
    """Trusted live claims that overlap their successor in order of start, by line."""
    rows = liveness.with_liveness(t, NOW).where("live").where(liveness.is_trusted(t.config))
    order = Window.partitionBy(*LINE).orderBy(F.col("valid_start"), F.col("valid_end").asc_nulls_last(), "claim_id")
    rows = rows.withColumn("next", F.lead("valid_start").over(order))
    return rows.groupBy(*LINE).agg(F.count_if(F.col("next").isNotNull() & ~F.coalesce(F.col("valid_end") <= F.col("next"), F.lit(False))).alias("n_overlaps"))


@query
def date_parse(t):
    text = F.date_format("tx_time", "yyyy-MM-dd")
    # Years, months and days, instants with zone, and what is none of these: blanks, words, days that no month has.
    odd = F.when(F.col("n") % 3 == 0, "  ").when(F.col("n") % 3 == 1, "2024-02-30").otherwise("soon")
    instant = F.concat(F.date_format("tx_time", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("n") % 2 == 0, "Z").otherwise("+02:00"))
    kind = F.col("start_granularity")
    shown = F.when(F.col("n") % 11 == 0, odd).when(F.col("n") % 13 == 0, instant).when(kind == "year", F.concat(F.lit(" "), F.substring(text, 1, 4))).when(kind == "month", F.substring(text, 1, 7)).when(kind == "day", text).otherwise("24")
    p = scalars.parse_valid_date(shown)
    return t.claims.select("claim_id", p["at"].alias("at"), p["granularity"].alias("granularity"))


@query
def date_display(t):
    return t.claims.select("claim_id", scalars.format_valid_date(F.col("valid_start"), F.col("start_granularity")).alias("shown"), scalars.known_granularity(F.col("start_granularity")).alias("granularity"))


@query
def provenance_display(t):
    return t.claims.select("claim_id", scalars.provenance_display(F.col("provenance")).alias("provenance"))


@query
def json_values_display(t):
    return t.claims.select("claim_id", scalars.json_display(F.col("value_json")).alias("shown"))


@query
def ledger_stream_seq(t):
    rows = reads.sequence_numbers(t.ledger.select("agent_id", "entry_id", "recorded_at"), "agent_id", ["recorded_at", "entry_id"], F.date_trunc("hour", "recorded_at"))
    return rows.select("agent_id", "entry_id", "sequence")


@query
def max_criticality(t):
    live = fold.selected_claims(t, NOW)
    return live.groupBy("agent_id", "subject").agg(scalars.criticality_name(F.max(scalars.criticality_rank(F.col("criticality")))).alias("criticality"))
