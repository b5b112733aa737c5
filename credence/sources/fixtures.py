"""Claim tables derived from the star-schema tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from credence.schema import Config, Tables

NOW, AS_OF, VALID_AT = "2024-03-01 00:00:00", "2024-01-20 12:00:00", "1998-06-15 00:00:00"


def uid(text: str) -> str:
    h = f"md5({text})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


# {{STAMP}}: the type of times; {{LIST}} and {{NONE}}: an array and an empty one; {{events}} and {{orders}}: the tables. The added zero hours keep the optimizer from taking
# two columns of one branch of the union for one, after which it rejects its own plan.
_KEYED = f"""
  SELECT 'e' || event_id AS k, event_id AS n, 'agent-' || (user_id % 8) AS agent_id,
         CASE WHEN event_id % 50 = 0 THEN 'single:' || event_id ELSE 'user:' || user_id END AS subject, event_type AS predicate,
         CASE WHEN user_id % 5 = 0 THEN CAST(event_id % 3 AS STRING) WHEN event_id % 4 = 1 THEN '"' || event_type || '"' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS value_json,
         CASE user_id % 3 WHEN 0 THEN 'Functional' WHEN 1 THEN 'SetValued' ELSE 'Unknown' END AS cardinality,
         CASE WHEN event_id % 10 = 0 THEN 'ModelDerived' WHEN event_id % 10 = 1 THEN 'RecallReEntry' WHEN event_id % 2 = 0 THEN 'External_UserAsserted' ELSE 'External_ExternalFirstHand' END AS provenance,
         CAST(event_id % 6 AS INT) AS derivation_depth, CAST(ts AS {{STAMP}}) AS tx_time,
         CASE WHEN event_id % 5 <> 0 THEN CAST(ts - INTERVAL '1' HOUR * (event_id % 7) AS {{STAMP}}) END AS valid_start,
         CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN CAST(ts - INTERVAL '1' HOUR * (event_id % 7) + INTERVAL '6' HOUR AS {{STAMP}}) END AS valid_end,
         CAST(CASE event_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.7 ELSE 0.9 END AS FLOAT) AS valid_time_confidence,
         CASE event_id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS start_granularity,
         CASE event_id % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'day' ELSE 'instant' END AS end_granularity,
         CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS criticality, CAST(CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS FLOAT) AS value_confidence,
         CASE WHEN event_id % 20 IN (1, 10, 12) THEN {{LIST}}({uid("'claim:e' || (event_id - 1)")}) ELSE {{NONE}} END AS derived_from
  FROM {{events}}
  UNION ALL
  SELECT 'o' || o_orderkey, o_orderkey, 'orders-' || (o_custkey % 8), 'customer:' || o_custkey, 'last_status', '"' || o_orderstatus || '"', 'Functional', 'External_UserAsserted', 0,
         CAST(o_orderdate AS {{STAMP}}), CAST(o_orderdate + INTERVAL '0' HOUR AS {{STAMP}}),
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS {{STAMP}}), CAST(0.9 AS FLOAT), 'day', 'day', 'Medium', CAST(1.0 AS FLOAT),
         CASE WHEN o_orderkey % 12 = 0 THEN {{LIST}}({uid("'claim:o' || (o_orderkey - 1)")}) ELSE {{NONE}} END
  FROM {{orders}}
"""
_CLAIMS = f"""
  SELECT {uid("'claim:' || k")} AS claim_id, * FROM ({_KEYED}) keyed
"""
_LEDGER_ROWS = """
  SELECT claim_id, agent_id, 1 AS stream_seq, 'ClaimCommitted' AS event_kind,
         CASE WHEN n % 23 = 0 THEN 'Quarantined' WHEN n % 7 = 3 AND agent_id LIKE 'agent%' THEN 'Contested' WHEN provenance = 'ModelDerived' THEN 'CommittedInferred' ELSE 'CommittedCheap' END AS disposition, tx_time AS recorded_at FROM {claims}
  UNION ALL SELECT claim_id, agent_id, 2, 'ValidityAsserted', 'Superseded', tx_time + INTERVAL '1' DAY FROM {claims} WHERE n % 11 = 0 AND n % 22 <> 0
  UNION ALL SELECT claim_id, agent_id, 3, 'DependentFlaggedPendingReview', 'PendingReview', tx_time + INTERVAL '2' HOUR FROM {claims} WHERE n % 13 = 0
  UNION ALL SELECT claim_id, agent_id, 4, 'ServedAsInjected', 'CommittedCheap', tx_time + INTERVAL '2' HOUR FROM {claims} WHERE n % 17 = 0
  UNION ALL SELECT claim_id, agent_id, 5, 'AdjudicationRequested', 'QueuedForAdjudication', tx_time + INTERVAL '4' DAY FROM {claims} WHERE n % 19 = 0
"""
_LEDGER = f"""
  SELECT {uid("'ledger:' || stream_seq || claim_id")} AS entry_id, agent_id, claim_id, event_kind, disposition, CAST(NULL AS STRING) AS rationale_json,
         CAST(recorded_at AS {{STAMP}}) AS recorded_at, CAST(stream_seq AS BIGINT) AS stream_seq FROM ({_LEDGER_ROWS}) entries
"""
_ASSERTIONS = f"""
  SELECT {uid("'bound:' || claim_id")} AS assertion_id, agent_id, claim_id AS target_claim_id, 'Bound' AS kind, CAST(tx_time + INTERVAL '1' DAY AS {{STAMP}}) AS effective_at, CAST(tx_time + INTERVAL '1' DAY AS {{STAMP}}) AS asserted_at FROM {{claims}} WHERE n % 11 = 0
  UNION ALL
  SELECT {uid("'reopen:' || claim_id")}, agent_id, claim_id, 'Reopen', CAST(tx_time + INTERVAL '2' DAY AS {{STAMP}}), CAST(tx_time + INTERVAL '2' DAY AS {{STAMP}}) FROM {{claims}} WHERE n % 22 = 0
"""
# Chains of ten claims, and what depends on the second of each ten.
_EDGES = f"""
  SELECT {uid("'derived:' || claim_id")} AS edge_id, agent_id, claim_id AS from_claim_id, {uid("'claim:' || substr(k, 1, 1) || (n - 1)")} AS to_claim_id, 'DerivedFrom' AS edge_kind, tx_time AS created_at FROM {{claims}} WHERE n % 10 <> 0
  UNION ALL
  SELECT {uid("'depends:' || claim_id")}, agent_id, claim_id, {uid("'claim:' || substr(k, 1, 1) || (n - n % 11)")}, 'DependsOn', tx_time FROM {{claims}} WHERE n % 6 = 1 AND n % 11 <> 0
"""
_PENDING = f"""
  SELECT {uid("'handle:' || claim_id")} AS handle_id, agent_id, subject, predicate, claim_id AS challenger_claim_id, {uid("'claim:' || substr(k, 1, 1) || (n - 1)")} AS incumbent_claim_id,
         CAST(tx_time + INTERVAL '4' DAY AS {{STAMP}}) AS queued_at, CASE WHEN n % 3 <> 0 THEN CAST(tx_time + INTERVAL '14' DAY AS {{STAMP}}) END AS expires_at,
         CASE WHEN n % 5 = 0 THEN 'resolved' ELSE 'pending' END AS status, CAST(CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seq
  FROM {{claims}} WHERE n % 19 = 0 AND n % 38 <> 0
"""


def tables(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Tables:
    """The five tables over whole `events` and `orders`."""
    stamp = lambda sql: sql.replace("{STAMP}", "TIMESTAMP_NTZ").replace("{LIST}", "array").replace("{NONE}", "CAST(array() AS ARRAY<STRING>)")
    events, orders = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    claims = spark.sql(stamp(_CLAIMS), events=events, orders=orders)
    of = lambda sql: spark.sql(stamp(sql), claims=claims)
    return Tables(claims, of(_ASSERTIONS), of(_LEDGER), of(_EDGES), of(_PENDING), config or Config())


def duckdb_ctes() -> str:
    """The same tables as common table expressions."""
    sql = lambda s: s.replace("{STAMP}", "TIMESTAMP").replace("{LIST}", "list_value").replace("{NONE}", "CAST([] AS VARCHAR[])").replace("{events}", "events").replace("{orders}", "orders").replace("{claims}", "claims").replace("AS STRING", "AS VARCHAR")
    return f"claims AS ({sql(_CLAIMS)}), ledger AS ({sql(_LEDGER)}), assertions AS ({sql(_ASSERTIONS)}), edges AS ({sql(_EDGES)}), pending AS ({sql(_PENDING)})"
