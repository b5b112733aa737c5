import datetime as dt
import random

import pytest

from credence import engine as ce
from credence.errors import DuplicateClaim, MissingProvenance
from credence.operators import fold
from credence.schema import CLAIMS
from credence.sources.store import ClaimStore
from credence.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def claim(i, subject, value, day, start=None, end=None, provenance="External_UserAsserted"):
    at = lambda n: None if n is None else T0 + dt.timedelta(days=n)
    row = {"claim_id": f"c{i}", "agent_id": "a", "subject": subject, "predicate": "p", "value_json": value, "cardinality": "Functional", "provenance": provenance, "derivation_depth": 0,
           "tx_time": at(day), "valid_start": at(start), "valid_end": at(end), "valid_time_confidence": 0.9, "criticality": "Low"}
    return tuple(row.get(c.split()[0]) for c in CLAIMS.split(", "))


def test_stream_of_claims(spark, tmp_path):
    columns = ", ".join(x.strip() for x in CLAIMS.split(","))
    store, folder = ClaimStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/in"
    claims = lambda rows: spark.createDataFrame([tuple(r) for r in rows], columns).coalesce(1).write.mode("append").parquet(folder)
    claims([claim(1, "s", "1", 5, 0, 2), claim(2, "s", "2", 6, 3), claim(3, "t", "1", 5), claim(4, "t", "2", 6), claim(5, "u", "1", 5, 9)])
    ingest.stream_into(store, folder, f"file://{tmp_path}/cp").awaitTermination()
    claims([claim(6, "s", "3", 7, 4), claim(7, "t", "1", 8), claim(8, "v", "1", 8, provenance="ModelDerived")])
    ingest.stream_into(store, folder, f"file://{tmp_path}/cp").awaitTermination()
    got = {r.claim_id: r.disposition for r in store.table("ledger").collect()}
    assert got == {"c1": "CommittedCheap", "c2": "CommittedCheap", "c3": "CommittedCheap", "c4": "Contested", "c5": "Quarantined", "c6": "Contested", "c7": "CommittedCheap", "c8": "CommittedInferred"}
    status = {r.subject: r.status for r in fold.beliefs(store.tables(), T0 + dt.timedelta(days=30)).collect()}
    assert status == {"s": "Contested", "t": "Contested", "u": "NoBelief", "v": "TimingUncertain"}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(x.strip() for x in CLAIMS.split(",")))


def test_batches_are_committed_once(spark, tmp_path):
    store, rows = ClaimStore(spark, f"file://{tmp_path}"), [claim(1, "s", "1", 5), claim(2, "s", "2", 6)]
    ingest.append(store, frame(spark, rows), key=("feed", 3))
    assert ingest.append(store, frame(spark, rows), key=("feed", 3)) is None and ingest.append(store, frame(spark, rows), key=("feed", 2)) is None
    with pytest.raises(DuplicateClaim):
        ingest.append(store, frame(spark, rows))
    with pytest.raises(DuplicateClaim):
        ingest.append(store, frame(spark, [claim(9, "s", "1", 5)] * 2))
    with pytest.raises(MissingProvenance):
        ingest.append(store, frame(spark, [claim(8, "s", "1", 5, provenance=None), claim(7, "s", "1", 5)]))
    assert store.table("claims").count() == 2 and store.version() == 1
    assert ingest.append(store, frame(spark, []), key=("feed", 4)).count() == 0


def test_many_repeats_of_one_claim_leave_one_row(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}")
    ingest.append(store, frame(spark, [claim(0, "s", "1", 1)]))
    echo = frame(spark, [claim(i, "s", "1", 2, provenance="RecallReEntry") for i in range(1, 809)])
    out = ingest.append(store, echo.selectExpr("* except (derived_from)", "array('c0') as derived_from")).collect()
    assert {(r.claim_ref, r.disposition) for r in out} == {("c0", "CommittedCheap")} and len(out) == 808
    assert store.table("claims").count() == 1 and store.table("edges").count() == 0


@pytest.mark.parametrize("with_oracle", [False, True])
def test_a_batch_equals_single_writes(spark, with_oracle):
    rng, day = random.Random(11), lambda n: T0 + dt.timedelta(days=n)
    rows = []
    for i in range(14):
        start = rng.choice([None, 0, 2, 4, 6, 30])
        rows.append({"claim_id": f"c{i:02d}", "agent_id": rng.choice("ab"), "subject": rng.choice("st"), "predicate": "p", "value_json": rng.choice(['{"b": 1, "a": 2}', '{"a":2,"b":1}', "1", "1.0"]), "cardinality": "Functional", "derivation_depth": 0,
                     "provenance": rng.choice(["External_UserAsserted", "External_ExternalFirstHand", "ModelDerived", "RecallReEntry"]), "tx_time": day(5 + i // 2), "valid_start": None if start is None else day(start), "valid_end": rng.choice([None, None if start is None else day(start + rng.choice([-1, 2]))]),
                     "valid_time_confidence": rng.choice([0.9, 0.9, 0.3]), "value_confidence": 1.0, "criticality": "Low", "derived_from": [f"c{rng.randrange(i):02d}"] if i and rng.random() < 0.3 else []})
    import json

    ids = {}
    clock = iter(r["tx_time"] for r in rows)
    oracle = (lambda agent, request: f"h-{request['challenger']}") if with_oracle else None
    with ce.Engine.in_memory(spark, oracle=oracle, clock=lambda: next(clock)) as one, ce.Engine.in_memory(spark, oracle=oracle) as many:
        for r in rows:
            named = {k: r[k] for k in ("cardinality", "valid_start", "valid_end", "valid_time_confidence")} | {"derived_from": [ids.get(d, d) for d in r["derived_from"]]}
            ids[r["claim_id"]] = one.ingest(r["agent_id"], r["subject"], r["predicate"], json.loads(r["value_json"]), r["provenance"], **named)["claim_ref"]
        back = {}
        for k, v in ids.items():
            back.setdefault(v, k)
        out = many.ingest_batch(frame(spark, [[r.get(c.split()[0]) for c in (x.strip() for x in CLAIMS.split(","))] for r in rows]))
        assert sum(r.disposition is not None for r in out.collect()) == len(rows)

        def state(e, names):
            name = lambda c: names.get(c, c)
            t = e.store.tables()
            return (
                sorted((name(r.claim_id), r.value_json) for r in t.claims.collect()), sorted((name(r.claim_id), r.event_kind, r.disposition) for r in t.ledger.collect()),
                sorted((name(r.from_claim_id), name(r.to_claim_id), r.edge_kind) for r in t.edges.collect()), sorted((name(r.challenger_claim_id), name(r.incumbent_claim_id), r.status) for r in t.pending.collect()),
            )

        assert state(many, {k: back[v] for k, v in ids.items()}) == state(one, back)  # a claim derived from a re-entry is derived from what that repeats
        assert len(many.pending()) == (len(one.pending()) if with_oracle else 0)
