import datetime as dt
import random

import pytest

from credence import engine as ce
from credence.operators import fold, line_model
from credence.schema import ASSERTIONS, CLAIMS, EDGES, LEDGER, LINE, PENDING, Config, Tables
from credence.errors import CommitConflict, DuplicateEdge
from credence.sources import store as stores
from credence.sources.store import ClaimStore
from credence.tools import Tools

T0 = dt.datetime(2024, 1, 1)


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        self.now += dt.timedelta(seconds=1)
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    return ce.Engine(spark, f"file://{tmp_path}", clock=Clock())


def test_remember_and_recall(engine):
    first = engine.remember("a", "alice", "city", "Berlin")
    assert engine.recall("a", "alice", "city")["value"] == "Berlin"
    second = engine.remember("a", "alice", "city", "Paris")
    assert (second["disposition"], second["contested_with"]) == ("Contested", [first["claim_ref"]])
    got = engine.recall("a", "alice", "city")
    assert got["status"] == "Contested" and got["value"] is None and got["candidates"] == ["Berlin", "Paris"]
    assert engine.recall("a", "alice", "city", as_of=T0 + dt.timedelta(seconds=1))["value"] == "Berlin"
    out = engine.reconcile("a", [("alice", "city")])
    assert out["oracle_escalations"] == 1
    assert [h["status"] for h in engine.history("a", "alice", "city")] == ["Superseded", "Current"]
    assert engine.reconcile("a", []) == {"outcomes": [], "oracle_escalations": 0}
    assert {r["event_kind"] for r in engine.audit("a")} == {"ClaimCommitted", "AdjudicationResolved", "ValidityAsserted"}
    with pytest.raises(ce.IncoherentDates):
        engine.remember("a", "x", "y", 1, valid_from="2024", valid_until="2023-05")
    with pytest.raises(ce.UnparsableDate):
        engine.remember("a", "x", "y", 1, valid_from="someday")


def test_succession_and_echo(engine):
    one = engine.remember("a", "acme", "ceo", "alice", valid_from="2020", valid_until="2022")
    assert engine.remember("a", "acme", "ceo", "bob", valid_from="2022")["disposition"] == "CommittedCheap"
    assert engine.recall("a", "acme", "ceo", valid_at="2021-06")["value"] == "alice"
    assert engine.recall("a", "acme", "ceo")["value"] == "bob"
    assert engine.recall("a", "acme", "ceo", valid_at="2019")["status"] == "NoBelief"
    again = engine.ingest("a", "acme", "ceo", "alice", "RecallReEntry", derived_from=[one["claim_ref"]])
    assert again["claim_ref"] == one["claim_ref"] and engine.tables.claims.count() == 2
    derived = engine.ingest("a", "acme", "mood", "fine", "ModelDerived", derived_from=[one["claim_ref"]])
    assert derived["disposition"] == "CommittedInferred"
    assert [r.to_claim_id for r in engine.lineage("a", derived["claim_ref"]).collect()] == [one["claim_ref"]]
    assert [f["predicate"] for f in engine.subject_facts("a", "acme")] == ["ceo", "mood"]
    with pytest.raises(ce.MissingProvenance):
        engine.ingest("a", "s", "p", 1, None)


@pytest.mark.parametrize("verdict,value", [("Affirm", "Paris"), ("Deny", "Berlin"), ("Unknown", None)])
def test_verdicts(spark, tmp_path, verdict, value):
    handles = iter(("h1", "h2"))
    e = ce.Engine(spark, f"file://{tmp_path}", oracle=lambda agent, request: next(handles), clock=Clock())
    e.remember("a", "alice", "city", "Berlin")
    assert e.remember("a", "alice", "city", "Paris")["disposition"] == "QueuedForAdjudication"
    assert [p["handle_id"] for p in e.pending()] == ["h1"]
    e.submit_adjudication("h1", verdict, evidence={"seen": "passport"})
    assert any("passport" in (r["rationale_json"] or "") for r in e.audit("a")) and e.adjudication("h1")["status"] == "resolved"
    assert e.recall("a", "alice", "city")["value"] == value and e.pending() == []
    with pytest.raises(ce.HandleNotFound):
        e.submit_adjudication("h1", verdict)


def test_expiry(spark, tmp_path):
    e = ce.Engine(spark, f"file://{tmp_path}", Config(default_adjudication_ttl=dt.timedelta(microseconds=1)), lambda agent, request: "h", Clock())
    e.remember("a", "alice", "city", "Berlin")
    e.remember("a", "alice", "city", "Paris")
    assert e.sweep() == 1 and e.sweep() == 0
    assert e.recall("a", "alice", "city")["status"] == "Contested"


def test_commits_are_whole_and_exclusive(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}")
    row = {"edge_id": "e", "agent_id": "a", "from_claim_id": "x", "to_claim_id": "y", "edge_kind": "DerivedFrom", "created_at": T0}
    store.commit({"edges": [row]})
    stale = store.snapshot()
    store.commit({"edges": [row | {"to_claim_id": "z"}]})
    late, other = ClaimStore(spark, f"file://{tmp_path}"), row | {"to_claim_id": "w"}
    with pytest.raises(CommitConflict):
        late.commit({"edges": [other]}, expected=stale.version)
    late.snapshot = lambda: stale  # as if the other commit came between reading and the manifest
    with pytest.raises(CommitConflict):
        late.commit({"edges": [other]})
    with pytest.raises(DuplicateEdge):
        store.commit({"edges": [row | {"edge_id": "f"}]})
    with pytest.raises(DuplicateEdge):
        store.commit({"edges": [other, other]})
    assert {r.to_claim_id for r in store.table("edges").collect()} == {"y", "z"}


def test_a_writer_that_is_overtaken_reads_again(spark, tmp_path):
    one, two = (ce.Engine(spark, f"file://{tmp_path}", clock=Clock()) for _ in range(2))
    tables, calls = one.store.tables, []

    def overtaken(now):
        calls.append(now.version)
        if len(calls) == 1:  # the other one writes after this one has read
            two.remember("a", "alice", "city", "Paris")
        return tables(now)

    one.store.tables = overtaken
    got = one.remember("a", "alice", "city", "Berlin")
    assert got["disposition"] == "Contested" and calls == [0, 1]
    seq = one.store.table("ledger").orderBy("stream_seq").collect()
    assert [r.stream_seq for r in seq] == [1, 2]


def test_numbers_run_by_agent(spark, tmp_path):
    e = ce.Engine(spark, f"file://{tmp_path}", clock=Clock())
    for agent, value in (("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)):
        e.remember(agent, "s", "p", value)
    e.reconcile("a", [("s", "p")])
    for agent in "ab":
        rows = e.store.table("ledger").where(f"agent_id = '{agent}'").orderBy("stream_seq").collect()
        assert [r.stream_seq for r in rows] == list(range(1, len(rows) + 1))


def test_checkpoints_and_compaction_keep_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "CHECKPOINT_EVERY", 3)
    store = ClaimStore(spark, f"file://{tmp_path}")
    row = {"edge_id": "e", "agent_id": "a", "from_claim_id": "x", "edge_kind": "DerivedFrom", "created_at": T0}
    for i in range(7):
        store.commit({"edges": [row | {"to_claim_id": f"y{i}"}]}, key=("feed", i))
    assert sum(n.startswith("checkpoint") for n in store._names()) == 2 and store.snapshot().version == store.version() == 7
    assert store.commit({"edges": [row | {"to_claim_id": "again"}]}, key=("feed", 6)) == 6
    store.compact()
    assert len(store.snapshot().folders["edges"]) == 1 and store.vacuum() == 7
    assert {r.to_claim_id for r in store.table("edges").collect()} == {f"y{i}" for i in range(7)}
    assert store.snapshot().knows(("feed", 6)) and not store.snapshot().knows(("feed", 7))


def test_old_files_and_unknown_names(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}")
    old = spark.createDataFrame([("c", "a", "s", "p", "1", "Functional", "ModelDerived", T0)], "claim_id string, agent_id string, subject string, predicate string, value_json string, cardinality string, provenance string, tx_time timestamp_ntz")
    old.write.parquet(f"file://{tmp_path}/data/old/claims")  # as before there were granularities
    store._create("000000000000.json", {"number": 0, "tables": {"claims": f"file://{tmp_path}/data/old/claims"}})
    got = store.table("claims").collect()[0]
    assert got.claim_id == "c" and got.start_granularity is None and got.end_granularity is None
    store.commit({"claims": [{"claim_id": "d", "cardinality": "Functional", "start_granularity": "decade"}]})
    assert store.table("claims").where("claim_id = 'd'").collect()[0].start_granularity is None
    store.commit({"claims": [{"claim_id": "e", "cardinality": "Plural"}]})
    with pytest.raises(Exception, match="claims.cardinality: unknown value Plural") as e:
        store.table("claims").collect()
    assert ce.told(e.value)["type"] == "UnknownName"


def test_displays_and_points(spark):
    with ce.Engine.in_memory(spark, clock=Clock()) as e:
        ref = e.remember("a", "acme", "ceo", "alice", valid_from="2020", valid_until="2031-05", confidence=0.75)["claim_ref"]
        got = e.recall("a", "acme", "ceo")
        assert (got["valid_from"], got["valid_until"], got["confidence"], got["provenance"]) == ("2020", "2031-05", 0.75, "External_UserAsserted")
        primary = e.belief("a", "acme", "ceo")["primary"]
        assert primary["valid_from_display"] == "2020" and primary["corroboration_count"] == 0 and primary["last_refreshed_at"] == primary["tx_time"]
        e.remember("a", "acme", "hq", "Oslo", valid_from="2021-02-03")
        assert "valid_until_display" not in e.belief("a", "acme", "hq")["primary"]
        facts = {f["predicate"]: f for f in e.subject_facts("a", "acme")}
        assert (facts["ceo"]["confidence"], facts["ceo"]["valid_until_display"], facts["hq"]["valid_from_display"], facts["hq"]["valid_until_display"]) == (0.75, "2031-05", "2021-02-03", None)
        e.remember("a", "acme", "hq", "Bergen")
        facts = {f["predicate"]: f for f in e.subject_facts("a", "acme")}
        assert facts["hq"]["status"] == "Contested" and facts["hq"]["valid_from_display"] is None and facts["hq"]["value"] in ("Oslo", "Bergen")
        assert e.claim("a", ref)["value_json"] == '"alice"' and e.current("a", "acme", "ceo")["valid_from_display"] == "2020"
        with pytest.raises(ce.ClaimNotFound):
            e.claim("b", ref)
        root = e.store.root
    assert not e.store._fs.exists(e.store._path(root))


def test_provenances_and_errors():
    for text in ("External:UserAsserted", "external:user-asserted", " EXTERNAL : user_asserted ", "External_UserAsserted", {"type": "External", "kind": "UserAsserted"}):
        assert ce.parse_provenance(text) == "External_UserAsserted"
    assert ce.parse_provenance("External:ExternalFirstHand") == "External_ExternalFirstHand" and ce.parse_provenance("recall-re-entry") == "RecallReEntry" and ce.parse_provenance({"type": "ModelDerived"}) == "ModelDerived"
    for text in ("External", "hearsay", "External:Rumour", 7):
        with pytest.raises(ce.ValidationError):
            ce.parse_provenance(text)
    assert ce.told(ce.HandleNotFound("h")) == {"error": "not_found", "type": "HandleNotFound", "message": "h"}
    assert ce.told(ValueError("x"))["error"] == "validation" and ce.told(RuntimeError("x"))["error"] == "store"


def test_tools(spark):
    with ce.Engine.in_memory(spark, clock=Clock()) as e:
        t = Tools(e, "me")
        one = t.ingest_claim("alice", "age", 30, "External:UserAsserted")
        two = t.ingest_claim("alice", "age", "30", "external:external-first-hand")
        assert one["disposition"] == "CommittedCheap" and "status_reason" not in one
        assert two["disposition"] == "Contested" and two["contested_with"] == [one["claim_ref"]] and two["status_reason"]  # a text is no number
        got = t.query_memory("alice", "age")
        assert got["belief"]["status"] == "Contested" and got["status_reason"]
        assert t.reconcile([["alice", "age"]])["oracle_escalations"] == 1
        assert len(t.audit(limit=2)["entries"]) == 2
        assert t.ingest_claim("alice", "age", 1, "hearsay")["error"] == "validation" and t.ingest_claim("alice", "age", 1, None)["type"] == "MissingProvenance"


def test_oracle_that_fails_leaves_an_orphan_for_the_sweep(spark, tmp_path):
    def broken(agent, request):
        raise RuntimeError("away")

    e = ce.Engine(spark, f"file://{tmp_path}", oracle=broken, clock=Clock())
    e.remember("a", "alice", "city", "Berlin")
    with pytest.raises(ce.OracleError):
        e.remember("a", "alice", "city", "Paris")
    assert e.pending() == [] and e.sweep() == 1 and e.recall("a", "alice", "city")["status"] == "Contested"


def test_fold_equals_the_line_model(spark):
    rng, day = random.Random(5), lambda n: T0 + dt.timedelta(days=n)
    claims, ledger, assertions, lines = [], [], [], {}
    for n in range(150):
        for k in range(rng.randrange(1, 5)):
            start = rng.choice([None, rng.randrange(12), 4 * k])
            c = {"claim_id": f"{n:03d}-{k}", "agent_id": "a", "subject": f"s{n}", "predicate": "p", "value_json": str(rng.randrange(3)), "cardinality": rng.choice(["Functional", "SetValued", "Unknown"]), "provenance": "External_UserAsserted", "derivation_depth": 0,
                 "tx_time": day(rng.randrange(10)), "valid_start": None if start is None else day(start), "valid_end": None if start is None or rng.random() < 0.3 else day(start + rng.choice([-1, 0, 4])), "valid_time_confidence": rng.choice([0.7, 0.9, 0.9, 0.3]), "criticality": "Low"}
            claims.append(c)
            c = c | {"disposition": None, "assertions": []}
            if rng.random() < 0.5:
                c["disposition"] = rng.choice(["CommittedCheap", "Contested", "Superseded", "Quarantined"])
                ledger.append({"entry_id": c["claim_id"], "agent_id": "a", "claim_id": c["claim_id"], "event_kind": "ClaimCommitted", "disposition": c["disposition"], "recorded_at": T0, "stream_seq": 1})
            for i in range(rng.choice([0, 0, 1, 2])):
                a = (day(rng.randrange(14)), f"{c['claim_id']}-{i}", rng.choice(["Bound", "Reopen"]), day(rng.randrange(14)))
                c["assertions"].append(a)
                assertions.append({"asserted_at": a[0], "assertion_id": a[1], "kind": a[2], "effective_at": a[3], "target_claim_id": c["claim_id"], "agent_id": "a"})
            lines.setdefault(c["subject"], []).append(c)
    make = lambda rows, schema: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    flat = ", ".join(x.strip() for x in CLAIMS.split(","))
    t = Tables(make(claims, flat), make(assertions, ", ".join(x.strip() for x in ASSERTIONS.split(","))), make(ledger, ", ".join(x.strip() for x in LEDGER.split(","))), spark.createDataFrame([], EDGES), spark.createDataFrame([], PENDING))
    for as_of, valid_at in ((day(5), None), (day(20), None), (day(20), day(6))):
        got = {r.subject: (r.status, r.n_live, r.primary.claim_id if r.primary else None) for r in fold.beliefs(t, as_of, valid_at).select(*LINE, "status", "n_live", "primary").collect()}
        want = {}
        for s, rows in lines.items():
            if any(c["tx_time"] <= as_of for c in rows):
                live = line_model.fold(rows, as_of, valid_at, Config())
                state = line_model.status(live)
                clash = len(live) > 1
                want[s] = (state, len(live), live[0]["claim_id"] if len(live) == 1 and not clash else None)
        assert got == want
