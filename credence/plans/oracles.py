"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from credence.sources.fixtures import AS_OF, NOW, VALID_AT, duckdb_ctes

LINE = "agent_id, subject, predicate"
_TRUST = "(valid_time_confidence >= CAST(0.7 AS FLOAT) AND valid_start IS NOT NULL)"
_RANK = "CASE criticality WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
_NAME = "CASE {} WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END"
_SHOWN_PROVENANCE = "CASE WHEN {0} LIKE 'External%' THEN 'External/' || substr({0}, 10) ELSE {0} END"
_SHOWN_VALUE = "CASE WHEN {0} LIKE '\"%' THEN substr({0}, 2, length({0}) - 2) ELSE {0} END"
_OKEY = "CASE WHEN valid_time_confidence >= CAST(0.7 AS FLOAT) THEN coalesce(valid_start, tx_time) ELSE tx_time END"


def _with(body: str, *extra: str) -> str:
    return f"WITH {', '.join([duckdb_ctes(), *extra])}\n{body}"


def _disp(as_of: str | None) -> str:
    where = "" if as_of is None else f"WHERE recorded_at <= TIMESTAMP '{as_of}'"
    return f"""disp AS (SELECT claim_id, arg_max(disposition, (recorded_at, stream_seq)) AS disposition,
      bool_or(event_kind = 'DependentFlaggedPendingReview' AND disposition = 'PendingReview') AS pending_review FROM ledger {where} GROUP BY claim_id)"""


def _live(as_of: str) -> list[str]:
    return [
        _disp(as_of),
        f"""state AS (SELECT target_claim_id AS claim_id, arg_max(kind, (asserted_at, assertion_id)) AS last_kind FROM assertions
      WHERE asserted_at <= TIMESTAMP '{as_of}' AND effective_at <= TIMESTAMP '{as_of}' GROUP BY 1)""",
        f"""known AS (SELECT c.*, {_OKEY} AS okey, disposition, pending_review,
      coalesce(last_kind, 'Reopen') = 'Reopen' AND coalesce(disposition, '') NOT IN ('Quarantined', 'Superseded', 'Invalidated', 'Rejected') AS live
      FROM claims c LEFT JOIN disp USING (claim_id) LEFT JOIN state USING (claim_id) WHERE tx_time <= TIMESTAMP '{as_of}')""",
    ]


def _selected(as_of: str, valid_at: str | None = None) -> list[str]:
    at = f"TIMESTAMP '{valid_at or as_of}'"
    return [
        *_live(as_of),
        f"""w AS (SELECT *, count(*) OVER (PARTITION BY {LINE}) AS n_line, bool_and({_TRUST}) OVER (PARTITION BY {LINE}) AS all_trusted FROM known WHERE live)""",
        f"""pairs AS (SELECT DISTINCT {', '.join('a.' + c for c in LINE.split(', '))} FROM w a JOIN w b ON a.agent_id = b.agent_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id
      WHERE a.all_trusted AND a.n_line > 1 AND NOT (coalesce(a.valid_end <= b.valid_start, false) OR coalesce(b.valid_end <= a.valid_start, false)))""",
        f"""sel AS (SELECT w.*, w.n_line > 1 AND w.all_trusted AND p.agent_id IS NULL AS succession FROM w LEFT JOIN pairs p USING ({LINE})
      WHERE NOT (w.n_line > 1 AND w.all_trusted AND p.agent_id IS NULL) OR (valid_start <= {at} AND (valid_end IS NULL OR {at} < valid_end)))""",
    ]


def _beliefs(as_of: str, valid_at: str | None = None, now: str | None = None) -> list[str]:
    age = f"((epoch_us(TIMESTAMP '{now or as_of}') - epoch_us(f.tx_time)) // 1000000)"
    return [
        *_selected(as_of, valid_at),
        f"""agg AS (SELECT {LINE}, count(*) AS n, count(*) FILTER (WHERE cardinality = 'Functional') AS nf, bool_or(cardinality <> 'SetValued') AS ns, bool_or(coalesce(disposition = 'Contested', false)) AS contested,
      bool_or(coalesce(pending_review, false)) AS review, bool_or(provenance = 'RecallReEntry') AS recall, bool_or(derivation_depth > 3) AS deep, max({_RANK}) AS rank,
      arg_min(claim_id, (okey, tx_time, claim_id)) AS first_claim FROM sel GROUP BY {LINE})""",
        f"""b AS (SELECT l.*, coalesce(n, 0) AS n_live, coalesce(nf > 1 OR (n > 1 AND ns), false) AS has_conflict, coalesce(contested, false) AS contested, review, recall, deep, coalesce(rank, 0) AS rank, first_claim
      FROM (SELECT DISTINCT {LINE} FROM claims WHERE tx_time <= TIMESTAMP '{as_of}') l LEFT JOIN agg USING ({LINE}))""",
        f"""belief AS (SELECT b.*, CASE WHEN n_live = 0 THEN 'NoBelief' WHEN b.contested OR has_conflict THEN 'Contested'
        WHEN n_live = 1 AND f.valid_start IS NULL AND f.valid_end IS NULL THEN 'TimingUncertain' ELSE 'Resolved' END AS status,
        CASE WHEN n_live = 1 AND NOT has_conflict THEN first_claim END AS primary_claim, CASE WHEN n_live = 1 AND NOT has_conflict THEN f.value_json END AS primary_value,
        CASE WHEN n_live = 0 THEN 'Decayed' WHEN {age} < 2592000 THEN 'Fresh' WHEN {age} < 7776000 THEN 'AgingUnconfirmed' ELSE 'Decayed' END AS currency,
        f.value_json AS first_value, f.provenance AS first_provenance, f.tx_time AS first_tx, f.value_confidence AS first_confidence,
        CASE WHEN n_live = 1 AND NOT has_conflict THEN CASE f.start_granularity WHEN 'year' THEN strftime(f.valid_start, '%Y') WHEN 'month' THEN strftime(f.valid_start, '%Y-%m') ELSE strftime(f.valid_start, '%Y-%m-%d') END END AS shown_from,
        CASE WHEN n_live = 1 AND NOT has_conflict THEN CASE f.end_granularity WHEN 'year' THEN strftime(f.valid_end, '%Y') WHEN 'month' THEN strftime(f.valid_end, '%Y-%m') ELSE strftime(f.valid_end, '%Y-%m-%d') END END AS shown_until
      FROM b LEFT JOIN claims f ON f.claim_id = b.first_claim)""",
    ]


_FLAT = f"SELECT {LINE}, status, n_live, has_conflict, primary_claim, primary_value, first_claim FROM belief"
_FACTS = f"""SELECT {LINE}, status, first_claim AS claim_id, {_SHOWN_VALUE.format('first_value')} AS value,
  first_confidence AS confidence, shown_from AS valid_from_display, shown_until AS valid_until_display, CASE WHEN first_claim IS NULL THEN 'none' ELSE {_SHOWN_PROVENANCE.format('first_provenance')} END AS provenance, currency FROM belief"""
_CONFLICT = f"""CASE WHEN c.value_json = i.value_json THEN 'NoConflict'
    WHEN {{single}} AND c.valid_time_confidence >= CAST(0.7 AS FLOAT) AND c.valid_start IS NOT NULL AND i.valid_time_confidence >= CAST(0.7 AS FLOAT) AND i.valid_start IS NOT NULL
         AND (coalesce(c.valid_end <= i.valid_start, false) OR coalesce(i.valid_end <= c.valid_start, false)) THEN 'Succession' ELSE 'SameLineConflict' END"""
_INCOHERENT = "(valid_time_confidence >= CAST(0.7 AS FLOAT) AND (coalesce(valid_start > valid_end, false) OR coalesce(valid_start > tx_time, false)))"


def _routed(source: str) -> str:
    return f"""routed AS (SELECT *, CASE WHEN provenance = 'RecallReEntry' THEN 'RecallTainted' WHEN {_INCOHERENT} THEN 'Quarantine' WHEN provenance = 'ModelDerived' THEN 'Inferred'
      WHEN conflict_type IN ('NoConflict', 'Succession') THEN 'CheapPath' ELSE 'HeavyPath' END AS route,
      CASE WHEN provenance = 'RecallReEntry' THEN 'CommittedCheap' WHEN {_INCOHERENT} THEN 'Quarantined' WHEN provenance = 'ModelDerived' THEN 'CommittedInferred'
      WHEN conflict_type IN ('NoConflict', 'Succession') THEN 'CommittedCheap' ELSE 'Contested' END AS disposition FROM {source})"""


def _first(rows: str, key: str, single: str) -> list[str]:
    return [
        f"head AS (SELECT {LINE}, arg_min(claim_id, {key}) AS head_id, count(*) AS n_head FROM {rows} GROUP BY {LINE})",
        f"judged AS (SELECT c.*, i.claim_id AS incumbent, {_CONFLICT.format(single=single)} AS conflict_type FROM {rows} c JOIN head USING ({LINE}) JOIN claims i ON i.claim_id = head_id)",
        _routed("judged"),
    ]


_GONE = "gone AS (SELECT DISTINCT x.claim_id FROM (SELECT claim_id, unnest(derived_from) AS parent FROM claims) x JOIN disp d ON d.claim_id = x.parent WHERE d.disposition = 'Superseded')"
_FOLLOWS = f"""c.valid_time_confidence >= CAST(0.7 AS FLOAT) AND c.valid_start IS NOT NULL AND i.valid_time_confidence >= CAST(0.7 AS FLOAT) AND i.valid_start IS NOT NULL
         AND (coalesce(c.valid_end <= i.valid_start, false) OR coalesce(i.valid_end <= c.valid_start, false))"""


def _others(scope: str) -> list[str]:
    """Every claim against the first other claim of its scope."""
    return [
        _disp(None), _GONE,
        f"head AS (SELECT {scope}, arg_min(claim_id, (tx_time, claim_id)) AS head_id, count(*) - 1 AS n_live FROM claims GROUP BY ALL)",
        f"""judged AS (SELECT c.*, i.claim_id AS incumbent, CASE WHEN i.claim_id IS NULL THEN 'NoConflict' WHEN g.claim_id IS NOT NULL THEN 'DependsOnSuperseded'
      WHEN c.predicate <> i.predicate THEN 'CrossLineConflict' WHEN c.value_json = i.value_json THEN 'NoConflict' WHEN n_live <= 1 AND {_FOLLOWS} THEN 'Succession' ELSE 'SameLineConflict' END AS conflict_type
      FROM claims c JOIN head USING ({scope}) LEFT JOIN claims i ON i.claim_id = head_id AND i.claim_id <> c.claim_id LEFT JOIN gone g ON g.claim_id = c.claim_id)""",
        _routed("judged").replace("ELSE 'Contested' END AS disposition", "WHEN conflict_type = 'DependsOnSuperseded' THEN 'QueuedForAdjudication' ELSE 'Contested' END AS disposition"),
    ]


_SERVED = ["f AS (SELECT agent_id, claim_id, min(recorded_at) AS first_at FROM ledger WHERE event_kind = 'ServedAsInjected' GROUP BY ALL)", "s AS (SELECT agent_id, arg_min(claim_id, (first_at, claim_id)) AS c FROM f GROUP BY agent_id)"]
# A batch replayed: nothing goes, so that what is live before a claim are the earlier claims of its line that weren't quarantined.
_REPLAY = [
    f"""fresh AS (SELECT claims.*, {_OKEY} AS okey, coalesce({_TRUST}, false) AS trust, coalesce({_INCOHERENT}, false) AND provenance <> 'RecallReEntry' AS parked FROM claims LEFT JOIN s USING (agent_id)
      WHERE NOT (provenance = 'RecallReEntry' AND coalesce(derived_from[1], s.c) IS NOT NULL))""",
    f"""clash AS (SELECT {', '.join('a.' + c for c in LINE.split(', '))}, min((b.tx_time, b.claim_id)) AS since FROM fresh a JOIN fresh b ON a.agent_id = b.agent_id AND a.subject = b.subject AND a.predicate = b.predicate
      AND NOT a.parked AND NOT b.parked AND (a.tx_time, a.claim_id) < (b.tx_time, b.claim_id) AND NOT (coalesce(a.valid_end <= b.valid_start, false) OR coalesce(b.valid_end <= a.valid_start, false)) GROUP BY ALL)""",
    """prior AS (SELECT c.claim_id, count(p.claim_id) AS n_prior, coalesce(bool_and(p.trust), true) AS all_trusted, arg_min(p.claim_id, (p.okey, p.tx_time, p.claim_id)) AS first_id,
      count(p.claim_id) FILTER (WHERE p.valid_start <= c.tx_time AND (p.valid_end IS NULL OR c.tx_time < p.valid_end)) AS n_at,
      arg_min(p.claim_id, (p.okey, p.tx_time, p.claim_id)) FILTER (WHERE p.valid_start <= c.tx_time AND (p.valid_end IS NULL OR c.tx_time < p.valid_end)) AS first_at
      FROM fresh c LEFT JOIN fresh p ON p.agent_id = c.agent_id AND p.subject = c.subject AND p.predicate = c.predicate AND NOT p.parked AND (p.tx_time, p.claim_id) < (c.tx_time, c.claim_id) GROUP BY c.claim_id)""",
    f"""against AS (SELECT c.*, CASE WHEN n_prior > 1 AND all_trusted AND NOT coalesce(k.since < (c.tx_time, c.claim_id), false) THEN first_at ELSE first_id END AS head_id,
      CASE WHEN n_prior > 1 AND all_trusted AND NOT coalesce(k.since < (c.tx_time, c.claim_id), false) THEN n_at ELSE n_prior END AS n_live FROM fresh c JOIN prior USING (claim_id) LEFT JOIN clash k USING ({LINE}))""",
    f"""judged AS (SELECT c.*, i.claim_id AS incumbent, CASE WHEN i.claim_id IS NULL OR c.value_json = i.value_json THEN 'NoConflict' WHEN c.n_live = 1 AND {_FOLLOWS} THEN 'Succession' ELSE 'SameLineConflict' END AS conflict_type
      FROM against c LEFT JOIN claims i ON i.claim_id = c.head_id)""",
]


_PENDING_NOW = "now_pending AS (SELECT handle_id, arg_max(status, seq) AS state, min(agent_id) AS agent_id, min(subject) AS subject, min(predicate) AS predicate, min(challenger_claim_id) AS challenger_claim_id, min(incumbent_claim_id) AS incumbent_claim_id, min(queued_at) AS queued_at, min(expires_at) AS expires_at FROM pending GROUP BY handle_id)"
_INCUMBENT = f"""last_entry AS (SELECT claim_id, arg_max(disposition, (recorded_at, stream_seq)) AS disposition, max(recorded_at) AS last_at FROM ledger GROUP BY claim_id),
incumbent AS (SELECT {LINE}, arg_max(c.claim_id, (last_at, c.claim_id)) AS incumbent_claim_id FROM claims c JOIN last_entry e USING (claim_id) WHERE disposition = 'CommittedCheap' GROUP BY {LINE})"""
_ORPHANS = f"""orphan AS (SELECT c.agent_id, c.subject, c.predicate, c.claim_id, coalesce(i.incumbent_claim_id, 'unknown') AS incumbent_claim_id FROM claims c JOIN last_entry e USING (claim_id)
  LEFT JOIN incumbent i USING ({LINE}) WHERE e.disposition = 'QueuedForAdjudication' AND NOT EXISTS (SELECT 1 FROM pending p WHERE p.challenger_claim_id = c.claim_id))"""


def oracle_sql() -> dict[str, str]:
    none_times = "CAST(NULL AS TIMESTAMP) AS valid_start, CAST(NULL AS TIMESTAMP) AS valid_end, CAST(0 AS FLOAT) AS valid_time_confidence"
    judged = ["verdict AS (SELECT p.*, CASE ascii(handle_id) % 3 WHEN 0 THEN 'Affirm' WHEN 1 THEN 'Deny' ELSE 'Unknown' END AS v FROM now_pending p JOIN last_entry e ON e.claim_id = p.challenger_claim_id "
              f"WHERE state = 'pending' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') AND e.disposition = 'QueuedForAdjudication')",
              """moved AS (SELECT agent_id, challenger_claim_id AS claim_id, incumbent_claim_id AS other, 'AdjudicationResolved' AS event_kind, 'CommittedCheap' AS disposition FROM verdict WHERE v = 'Affirm'
  UNION ALL SELECT agent_id, incumbent_claim_id, challenger_claim_id, 'ValidityAsserted', 'Superseded' FROM verdict WHERE v = 'Affirm'
  UNION ALL SELECT agent_id, challenger_claim_id, incumbent_claim_id, 'ValidityAsserted', 'Superseded' FROM verdict WHERE v = 'Deny'
  UNION ALL SELECT agent_id, unnest([challenger_claim_id, incumbent_claim_id]), NULL, 'AdjudicationResolved', 'Contested' FROM verdict WHERE v = 'Unknown')""",
              "cascade AS (SELECT DISTINCT e.agent_id, m.claim_id, m.other, e.from_claim_id FROM moved m JOIN edges e ON e.to_claim_id = m.claim_id AND e.edge_kind = 'DependsOn' WHERE m.disposition = 'Superseded')"]
    return {
        "subject_line_scan": _with(f"SELECT {LINE}, claim_id, value_json, tx_time, row_number() OVER (PARTITION BY {LINE} ORDER BY tx_time, claim_id) AS place FROM claims"),
        "subject_line_as_of": _with(f"SELECT {LINE}, claim_id, tx_time FROM claims WHERE tx_time <= TIMESTAMP '{AS_OF}'"),
        "claim_lookup": _with("SELECT claim_id, agent_id, value_json, provenance, criticality, valid_start, valid_end FROM claims"),
        "latest_disposition": _with("SELECT * FROM disp", _disp(None)),
        "latest_disposition_as_of": _with("SELECT * FROM disp", _disp(AS_OF)),
        "assertions_in_order": _with("SELECT assertion_id, target_claim_id, kind, row_number() OVER (PARTITION BY target_claim_id ORDER BY asserted_at, assertion_id) AS place FROM assertions"),
        "assertion_liveness": _with("SELECT * FROM state", *_live(AS_OF)),
        "live_claims": _with("SELECT claim_id, okey, live FROM known", *_live(AS_OF)),
        "succession_detect": _with(f"SELECT DISTINCT {LINE} FROM w LEFT JOIN pairs p USING ({LINE}) WHERE n_line > 1 AND all_trusted AND p.agent_id IS NULL", *_selected(NOW)),
        "valid_at_select": _with(f"SELECT {LINE}, claim_id, succession FROM sel", *_selected(NOW, VALID_AT)),
        "belief_current": _with(_FLAT, *_beliefs(NOW)),
        "belief_as_of": _with(_FLAT, *_beliefs(AS_OF, now=NOW)),
        "belief_valid_at": _with(_FLAT, *_beliefs(NOW, VALID_AT)),
        "belief_bitemporal": _with(_FLAT, *_beliefs("2000-01-01 00:00:00", VALID_AT, NOW)),
        "belief_currency": _with(f"SELECT {LINE}, currency, {_NAME.format('rank')} AS criticality FROM belief", *_beliefs(AS_OF, now=NOW)),
        "belief_staleness": _with(f"""SELECT {LINE}, n_live = 0 OR (primary_claim IS NOT NULL AND currency = 'Decayed') AS is_stale, CASE WHEN n_live = 0 THEN 'no live claim' WHEN primary_claim IS NULL THEN NULL
  WHEN currency = 'Decayed' THEN 'currency decayed: last refreshed at ' || strftime(first_tx, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(first_tx) % 1000000 = 0 THEN '' WHEN epoch_us(first_tx) % 1000 = 0 THEN strftime(first_tx, '.%g') ELSE strftime(first_tx, '.%f') END || '+00:00' WHEN currency = 'AgingUnconfirmed' THEN 'aging unconfirmed: asserted long ago, not yet reconfirmed' END AS stale_reason FROM belief""", *_beliefs(NOW)),
        "belief_markers": _with(f"SELECT {LINE}, concat_ws(',', CASE WHEN contested OR has_conflict THEN 'Contested' END, CASE WHEN review THEN 'PendingReview' END, CASE WHEN recall THEN 'RecallTainted' END, CASE WHEN deep THEN 'LowDerivationAnchor' END) AS markers FROM belief", *_beliefs(NOW)),
        "belief_set_valued": _with(f"SELECT {LINE}, n_live FROM belief WHERE status = 'Resolved' AND n_live > 1", *_beliefs(NOW)),
        "belief_alternatives": _with(f"SELECT {LINE}, claim_id, place FROM (SELECT *, count(*) OVER (PARTITION BY {LINE}) AS n_sel, row_number() OVER (PARTITION BY {LINE} ORDER BY okey, tx_time, claim_id) AS place FROM sel) WHERE n_sel > 1", *_selected(NOW)),
        "subject_facts": _with(_FACTS, *_beliefs(NOW)),
        "subject_facts_as_of": _with(_FACTS, *_beliefs(AS_OF, VALID_AT, NOW)),
        "predicates_distinct": _with(f"SELECT DISTINCT {LINE} FROM claims WHERE tx_time <= TIMESTAMP '{AS_OF}'"),
        "history_timeline": _with(f"SELECT {LINE}, c.claim_id, valid_start, lead(okey) OVER o AS valid_until, CASE WHEN s.claim_id IS NULL THEN 'Superseded' ELSE 'Current' END AS status, {_SHOWN_PROVENANCE.format('provenance')} AS provenance_display, row_number() OVER o AS place FROM (SELECT *, {_OKEY} AS okey FROM claims) c LEFT JOIN (SELECT claim_id FROM sel) s USING (claim_id) WINDOW o AS (PARTITION BY {LINE} ORDER BY okey, tx_time, c.claim_id)", *_selected(NOW)),
        "history_current": _with(f"SELECT {LINE}, arg_min(claim_id, (okey, tx_time, claim_id)) AS claim_id FROM sel GROUP BY {LINE}", *_selected(NOW)),
        "audit_ledger": _with("SELECT entry_id, agent_id, claim_id, event_kind, disposition, recorded_at FROM ledger WHERE recorded_at >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY recorded_at, stream_seq, entry_id LIMIT 1000"),
        "audit_by_claim": _with("SELECT claim_id, count(*) AS n, max(recorded_at) AS last FROM ledger GROUP BY claim_id"),
        "ledger_for_claims_semi": _with(f"SELECT entry_id, claim_id, event_kind, recorded_at FROM ledger WHERE recorded_at <= TIMESTAMP '{AS_OF}' AND claim_id IN (SELECT claim_id FROM known WHERE live)", *_live(AS_OF)),
        "injected_claims": _with("SELECT agent_id, claim_id, min(recorded_at) AS first_served FROM ledger WHERE event_kind = 'ServedAsInjected' GROUP BY ALL"),
        "edges_for_claim": _with("SELECT unnest(list_distinct([from_claim_id, to_claim_id])) AS claim_id, edge_id, edge_kind, from_claim_id, to_claim_id, created_at FROM edges"),
        "lineage_recursive": "WITH RECURSIVE " + duckdb_ctes() + """, l AS (SELECT c.claim_id AS root, e.edge_id, e.to_claim_id, 1 AS depth, c.agent_id FROM claims c JOIN edges e ON e.from_claim_id = c.claim_id AND e.agent_id = c.agent_id AND e.edge_kind = 'DerivedFrom'
  UNION ALL SELECT l.root, e.edge_id, e.to_claim_id, l.depth + 1, l.agent_id FROM l JOIN edges e ON e.from_claim_id = l.to_claim_id AND e.agent_id = l.agent_id AND e.edge_kind = 'DerivedFrom' WHERE l.depth < 64)
SELECT root, edge_id, to_claim_id, CAST(depth AS BIGINT) AS depth FROM l""",
        "dependents_cascade": _with("SELECT DISTINCT e.agent_id, e.to_claim_id AS claim_id, e.from_claim_id AS dependent FROM edges e JOIN disp d ON d.claim_id = e.to_claim_id WHERE e.edge_kind = 'DependsOn' AND d.disposition = 'Superseded'", _disp(None)),
        "pending_list": _with(f"SELECT handle_id, {LINE}, challenger_claim_id, incumbent_claim_id, queued_at, expires_at FROM now_pending WHERE state = 'pending'", _PENDING_NOW),
        "pending_expired": _with(f"SELECT handle_id, expires_at FROM now_pending WHERE state = 'pending' AND expires_at <= TIMESTAMP '{AS_OF}'", _PENDING_NOW),
        "orphans_anti_join": _with("SELECT * FROM orphan", _INCUMBENT, _ORPHANS),
        "incumbent_top1": _with("SELECT * FROM incumbent", _INCUMBENT),
        "gate_decisions": _with("SELECT claim_id, conflict_type, route, disposition FROM routed", *_others(LINE)),
        "gate_decisions_with_oracle": _with("SELECT claim_id, route, CASE WHEN disposition = 'Contested' THEN 'QueuedForAdjudication' ELSE disposition END AS disposition FROM routed", *_others(LINE)),
        "conflict_classification": _with("SELECT claim_id, agent_id, conflict_type, incumbent AS incumbent_claim_id FROM routed", *_others("agent_id, subject")),
        "firewall_verdicts": _with("SELECT claim_id, CASE WHEN n % 97 = 0 THEN 'Quarantine' WHEN provenance = 'RecallReEntry' AND coalesce(derived_from[1], s.c) IS NOT NULL THEN 'CorroborateByIdentity' WHEN derivation_depth > 2 THEN 'DepthCapExceeded' ELSE 'Admit' END AS verdict, CASE WHEN n % 97 <> 0 AND provenance = 'RecallReEntry' THEN coalesce(derived_from[1], s.c) END AS target FROM claims LEFT JOIN s USING (agent_id)",
                                   *_SERVED),
        "temporal_coherence": _with(f"SELECT claim_id, coalesce({_INCOHERENT}, false) AS incoherent, valid_start IS NULL AND valid_end IS NULL AS unknown_times FROM claims"),
        "ingest_replay": _with("SELECT claim_id, CASE WHEN incumbent = claim_id THEN 'NoConflict' ELSE conflict_type END AS conflict_type, route, disposition, CASE WHEN incumbent <> claim_id THEN incumbent END AS incumbent_claim_id FROM routed",
                               f"bare AS (SELECT * EXCLUDE (valid_start, valid_end, valid_time_confidence), {none_times} FROM claims)", *_first("bare", "(tx_time, claim_id)", "false")),
        "ingest_replay_timed": _with("""SELECT claim_id, conflict_type, route, disposition, CASE WHEN disposition = 'Contested' THEN incumbent END AS contested_with FROM routed""", *_SERVED, *_REPLAY, _routed("judged")),
        "pending_any_status": _with("SELECT handle_id, state AS status, challenger_claim_id, incumbent_claim_id, queued_at FROM now_pending", _PENDING_NOW),
        "belief_slots": _with(f"SELECT {LINE}, primary_claim AS claim_id, CASE WHEN primary_claim IS NOT NULL THEN first_confidence END AS confidence, shown_from AS valid_from_display, shown_until AS valid_until_display, CASE WHEN primary_claim IS NOT NULL THEN first_tx END AS last_refreshed_at, CASE WHEN primary_claim IS NOT NULL THEN CAST(0 AS BIGINT) END AS corroboration_count FROM belief", *_beliefs(NOW)),
        "reconcile_outcomes": _with("SELECT claim_id, route, disposition, route = 'HeavyPath' AS escalated, CASE WHEN route = 'HeavyPath' AND incumbent <> claim_id THEN incumbent END AS supersedes FROM routed", *_selected(NOW), *[x.replace("n_head FROM", "n_head FROM") for x in _first("(SELECT * EXCLUDE (disposition) FROM sel)", "(okey, tx_time, claim_id)", "n_head <= 1")]),
        "verdict_apply": _with("SELECT agent_id, claim_id, event_kind, disposition FROM moved UNION ALL SELECT agent_id, from_claim_id, 'DependentFlaggedPendingReview', 'PendingReview' FROM cascade", _PENDING_NOW, _INCUMBENT, *judged),
        "sweep_outcomes": _with(f"SELECT claim_id, 'orphaned' AS cause, 'AdjudicationExpired' AS event_kind, 'Contested' AS disposition FROM orphan UNION ALL SELECT challenger_claim_id, 'expired', 'AdjudicationExpired', 'Contested' FROM now_pending p JOIN last_entry e ON e.claim_id = p.challenger_claim_id WHERE state = 'pending' AND expires_at <= TIMESTAMP '{NOW}' AND e.disposition = 'QueuedForAdjudication'", _PENDING_NOW, _INCUMBENT, _ORPHANS),
        "overlap_pairs": _with(f"SELECT {LINE}, count(*) FILTER (WHERE nxt IS NOT NULL AND NOT coalesce(valid_end <= nxt, false)) AS n_overlaps FROM (SELECT *, lead(valid_start) OVER (PARTITION BY {LINE} ORDER BY valid_start, valid_end NULLS LAST, claim_id) AS nxt FROM known WHERE live AND {_TRUST}) GROUP BY {LINE}", *_live(NOW)),
        "date_parse": _with("""SELECT claim_id, (CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN date_trunc('second', tx_time) - CASE WHEN n % 2 = 0 THEN INTERVAL '0' HOUR ELSE INTERVAL '2' HOUR END
  WHEN start_granularity = 'year' THEN date_trunc('year', tx_time) WHEN start_granularity = 'month' THEN date_trunc('month', tx_time) WHEN start_granularity = 'day' THEN date_trunc('day', tx_time) END)::TIMESTAMP AS at,
  CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN 'instant' ELSE start_granularity END AS granularity FROM claims"""),
        "date_display": _with("SELECT claim_id, CASE start_granularity WHEN 'year' THEN strftime(valid_start, '%Y') WHEN 'month' THEN strftime(valid_start, '%Y-%m') ELSE strftime(valid_start, '%Y-%m-%d') END AS shown, start_granularity AS granularity FROM claims"),
        "provenance_display": _with(f"SELECT {_SHOWN_PROVENANCE.format('provenance')} AS provenance FROM claims".replace("SELECT ", "SELECT claim_id, ", 1)),
        "json_values_display": _with(f"SELECT claim_id, {_SHOWN_VALUE.format('value_json')} AS shown FROM claims"),
        "ledger_stream_seq": _with("SELECT agent_id, entry_id, row_number() OVER (PARTITION BY agent_id ORDER BY recorded_at, entry_id) AS sequence FROM ledger"),
        "max_criticality": _with(f"SELECT agent_id, subject, {_NAME.format(f'max({_RANK})')} AS criticality FROM sel GROUP BY ALL", *_selected(NOW)),
    }
