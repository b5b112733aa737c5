"""Firewall, conflict classification and gate as column expressions, and the closed form of a batch replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.scalars import threshold
from credence.schema import LINE, Config, Tables


def firewall(config: Config, burst: Column, injected: Column) -> Column:
    """Verdict on a candidate: provenance, derivation_depth, derived_from; injected: first injected claim or null."""
    target = F.coalesce(F.try_element_at("derived_from", F.lit(1)), injected)
    return (
        F.when(burst >= config.quarantine_burst_threshold, F.struct(F.lit("Quarantine").alias("verdict"), F.lit(None).cast("string").alias("target")))
        .when((F.col("provenance") == "RecallReEntry") & target.isNotNull(), F.struct(F.lit("CorroborateByIdentity").alias("verdict"), target.alias("target")))
        .when(F.col("derivation_depth") > config.derivation_depth_cap_for_overturning, F.struct(F.lit("DepthCapExceeded").alias("verdict"), F.lit(None).cast("string").alias("target")))
        .otherwise(F.struct(F.lit("Admit").alias("verdict"), F.lit(None).cast("string").alias("target")))
    )


def incoherent(config: Config) -> Column:
    """A trusted window that ends before it starts, or starts after it was recorded."""
    sure = F.col("valid_time_confidence") >= threshold(config.valid_time_confidence_threshold)
    return sure & (F.coalesce(F.col("valid_start") > F.col("valid_end"), F.lit(False)) | F.coalesce(F.col("valid_start") > F.col("tx_time"), F.lit(False)))


def conflict_type(config: Config, incumbent: str, n_live: Column, superseded: Column | None = None) -> Column:
    """Of a candidate row against a struct column with the incumbent's claim (null without one)."""
    i = lambda c: F.col(f"{incumbent}.{c}")
    trusted = lambda conf, start: (conf >= threshold(config.valid_time_confidence_threshold)) & start.isNotNull()
    apart = F.coalesce(F.col("valid_end") <= i("valid_start"), F.lit(False)) | F.coalesce(i("valid_end") <= F.col("valid_start"), F.lit(False))
    follows = (n_live <= 1) & trusted(F.col("valid_time_confidence"), F.col("valid_start")) & trusted(i("valid_time_confidence"), i("valid_start")) & apart
    same_line = (F.col("subject") == i("subject")) & (F.col("predicate") == i("predicate"))
    depends = F.lit(False) if superseded is None else F.coalesce(F.arrays_overlap("derived_from", superseded), F.lit(False))
    return (
        F.when(F.col(incumbent).isNull(), "NoConflict").when(depends, "DependsOnSuperseded")
        .when(same_line & (F.col("value_json") == i("value_json")), "NoConflict")
        .when(same_line & follows, "Succession").when(same_line, "SameLineConflict")
        .when(F.col("subject") == i("subject"), "CrossLineConflict").otherwise("NoConflict")
    )


def gate(config: Config, conflict: Column, has_incumbent: Column, oracle_present: bool) -> Column:
    """struct(route, disposition); the first condition that holds decides."""
    out = lambda route, disposition: F.struct(F.lit(route).alias("route"), F.lit(disposition).alias("disposition"))
    external = F.col("provenance").startswith("External_")
    fresh = external & conflict.isin("SameLineConflict", "CrossLineConflict") & F.lit(not oracle_present)
    return (
        F.when(F.col("provenance") == "RecallReEntry", out("RecallTainted", "CommittedCheap"))
        .when(incoherent(config), out("Quarantine", "Quarantined"))
        .when(F.col("provenance") == "ModelDerived", out("Inferred", "CommittedInferred"))
        .when((conflict == "NoConflict") | ~has_incumbent, out("CheapPath", "CommittedCheap"))
        .when(conflict == "Succession", out("CheapPath", "CommittedCheap"))
        .when(fresh, out("HeavyPath", "Contested"))
        .otherwise(out("HeavyPath", "QueuedForAdjudication"))
    )


def superseded_parents(t: Tables, superseded: DataFrame) -> DataFrame:
    """Claims with `gone`: what they are derived from that is superseded (claim_id), as long as their own list at most."""
    parents = t.claims.select("claim_id", F.explode("derived_from").alias("parent")).join(superseded.select(F.col("claim_id").alias("parent")), "parent", "left_semi")
    return t.claims.join(parents.groupBy("claim_id").agg(F.collect_set("parent").alias("gone")), "claim_id", "left")


def against_others(claims: DataFrame, scope: list[str], key: list[str], config: Config, oracle_present: bool = False) -> DataFrame:
    """Each claim against the first claim of its scope in the order `key`, if that is another one; `gone` as of superseded_parents()."""
    cols = ["claim_id", "subject", "predicate", "value_json", "valid_start", "valid_end", "valid_time_confidence"]
    first = claims.groupBy(*scope).agg(F.min_by(F.struct(*cols), F.struct(*key)).alias("head"), (F.count("*") - 1).alias("n_live"))
    rows = claims.join(first, scope).withColumn("incumbent", F.when(F.col("head.claim_id") != F.col("claim_id"), F.col("head")))
    return _decided(rows, config, F.col("n_live"), oracle_present, F.col("gone"))


def against_first(claims: DataFrame, key: list[str], config: Config, n_live: Column | None = None, oracle_present: bool = False) -> DataFrame:
    """Each claim against the first claim of its line in the order `key`: conflict_type, route, disposition.

    The first claim is an aggregate with partial sums, joined back, so that no line is sorted in one task.
    """
    cols = ["claim_id", "subject", "predicate", "value_json", "valid_start", "valid_end", "valid_time_confidence"]
    first = claims.groupBy(*LINE).agg(F.min_by(F.struct(*cols), F.struct(*key)).alias("incumbent"), F.count("*").alias("n_live"))
    return _decided(claims.join(first, list(LINE)), config, F.col("n_live") if n_live is None else n_live, oracle_present)


def _decided(rows: DataFrame, config: Config, n_live: Column, oracle_present: bool, superseded: Column | None = None) -> DataFrame:
    rows = rows.withColumn("conflict_type", conflict_type(config, "incumbent", n_live, superseded))
    rows = rows.withColumn("decision", gate(config, F.col("conflict_type"), F.col("incumbent").isNotNull(), oracle_present))
    return rows.select("*", F.col("decision.route").alias("route"), F.col("decision.disposition").alias("decided"))


def replay_without_times(t: Tables, oracle_present: bool = False) -> DataFrame:
    """Dispositions of a batch of claims without valid times, as one after the other would get them.

    Nothing is superseded by writing and nothing without times is quarantined, so that the incumbent of every later claim
    is the line's first.
    """
    none = F.lit(None).cast("timestamp_ntz")
    claims = t.claims.withColumn("valid_start", none).withColumn("valid_end", none).withColumn("valid_time_confidence", F.lit(0.0).cast("float"))
    cols = ["claim_id", "subject", "predicate", "value_json", "valid_start", "valid_end", "valid_time_confidence"]
    first = claims.groupBy(*LINE).agg(F.min_by(F.struct(*cols), F.struct("tx_time", "claim_id")).alias("head"))
    rows = claims.join(first, list(LINE)).withColumn("incumbent", F.when(F.col("head.claim_id") != F.col("claim_id"), F.col("head")))
    return _decided(rows, t.config, F.lit(1), oracle_present)
