"""Batches of new claims, also micro-batches of a stream, through firewall, classification and gate into a store.

A batch gives what writing its claims one by one in order of transaction time (then claim_id) would give: claims that only
repeat a known one are not written, every other gets its disposition against the live claims of its line, with edges to what
it is derived from and, with an oracle, a row in the adjudication queue.

A line's claims are decided in order in one task, as each depends on those before it. The rows stream through that task; it
holds the line's first live claim and their number, and the windows of the line only as long as these follow one another.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.errors import DuplicateClaim, MissingProvenance
from credence.functions.scalars import canonical_json
from credence.operators import line_model, reads
from credence.operators.liveness import with_liveness
from credence.schema import CLAIMS, LINE, Config, Tables
from credence.sources.staging import stage
from credence.sources.store import ClaimStore, Snapshot, checked, columns

DECIDED = "claim_id string, conflict_type string, route string, disposition string, contested_with string"
_USED = ["claim_id", "value_json", "cardinality", "provenance", "tx_time", "valid_start", "valid_end", "valid_time_confidence"]
FAR = dt.datetime(9999, 1, 1)


class LineState:
    """The live claims of one line as far as the next decision needs them. Claims only come, none goes."""

    def __init__(self, config: Config):
        self.config, self.n, self.first, self.follows = config, 0, None, True
        self.windows: list[tuple] = []  # start, end, claim of windows that don't end before they start; while they follow one another
        self.bent: list[dict] = []  # those that do

    def add(self, claim: dict) -> None:
        if self.follows:
            self.follows = line_model.trusted(claim, self.config) and all(line_model.apart(claim, b) for b in self.bent) and self._fits(claim)
            if not self.follows:
                self.windows, self.bent = [], []
        self.n += 1
        if self.first is None or line_model.okey(claim, self.config) < line_model.okey(self.first, self.config):
            self.first = claim

    def _fits(self, claim: dict) -> bool:
        start, end = claim["valid_start"], claim["valid_end"] or FAR
        if end < start:
            if any(not line_model.apart(claim, c) for *_, c in self.windows):
                return False
            self.bent.append(claim)
            return True
        at = bisect.bisect_left(self.windows, (start, end), key=lambda w: w[:2])
        if any(not line_model.apart(claim, self.windows[i][2]) for i in (at - 1, at) if 0 <= i < len(self.windows)):
            return False
        self.windows.insert(at, (start, end, claim))
        return True

    def seen_at(self, at: dt.datetime) -> tuple[dict | None, int]:
        """The first live claim and their number, of a succession only the claim whose window holds the instant."""
        if self.n < 2 or not self.follows:
            return self.first, self.n
        found = bisect.bisect_right(self.windows, at, key=lambda w: w[0]) - 1
        while found >= 0:  # an empty window may stand at the same start
            start, end, claim = self.windows[found]
            if start <= at < end:
                return claim, 1
            if start < at:
                break
            found -= 1
        return None, 0


def _plain(value):
    return None if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def _decide_sorted(frames: Iterator[pd.DataFrame], config: Config, oracle_present: bool) -> Iterator[pd.DataFrame]:
    """Rows sorted by line, transaction time, old before new, claim_id."""
    line, state = None, LineState(config)
    for pdf in frames:
        out = []
        for row in pdf.to_dict("records"):
            claim = {k: _plain(v) for k, v in row.items()}
            if (key := tuple(claim[c] for c in LINE)) != line:
                line, state = key, LineState(config)
            if not claim["is_new"]:
                state.add(claim)
                continue
            first, n = state.seen_at(claim["tx_time"])
            conflict, route, disposition = line_model.decide_against(claim, first, n, config, oracle_present)
            out.append((claim["claim_id"], conflict, route, disposition, first["claim_id"] if disposition in ("Contested", "QueuedForAdjudication") else None))
            if disposition != "Quarantined":
                state.add(claim)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])


def replay(t: Tables, new: DataFrame, oracle_present: bool = False) -> DataFrame:
    """Decisions on new claims, as writing them one by one would give."""
    config = t.config
    live = with_liveness(t, FAR).where("live").join(new.select(*LINE).distinct(), list(LINE), "left_semi").select(*LINE, *_USED)
    both = new.select(*LINE, *_USED, F.lit(True).alias("is_new")).unionByName(live.withColumn("is_new", F.lit(False)))
    dealt = both.repartition(*LINE).sortWithinPartitions(*LINE, "tx_time", "is_new", "claim_id")
    return dealt.mapInPandas(lambda frames: _decide_sorted(frames, config, oracle_present), DECIDED)


def known_targets(t: Tables, new: DataFrame) -> DataFrame:
    """new with `known`: the claim that a re-entry repeats (the first it names, else its agent's first served), else null."""
    served = reads.injected_claims(t).groupBy("agent_id").agg(F.min_by("claim_id", F.struct("first_served", "claim_id")).alias("served"))
    repeats = F.coalesce(F.try_element_at("derived_from", F.lit(1)), F.col("served"))
    return new.join(served, "agent_id", "left").withColumn("known", F.when(F.col("provenance") == "RecallReEntry", repeats)).drop("served")


def canonical_values(new: DataFrame) -> DataFrame:
    """new with its values as canonical JSON; what isn't JSON is refused."""

    @F.pandas_udf("string")
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(lambda v: None if v is None else canonical_json(json.loads(v)))

    return new.withColumn("value_json", canonical("value_json"))


def append(store: ClaimStore, new: DataFrame, oracle: Callable[[str, dict], str] | None = None, key: tuple[str, int] | None = None) -> DataFrame | None:
    """Decides a batch and commits claims, ledger, edges and queue as one unit.

    new: columns of claims. Returns claim_id, claim_ref (of a re-entry the claim that it repeats), disposition and
    contested_with, or nothing if a batch of this key (source, number) or a later one is committed already. oracle runs on the
    executors, once for each queued claim and attempt, and returns its handle. Claims without provenance, unknown names, and
    ids that are there already or come twice refuse the whole batch.
    """
    have = new.columns
    rows = new.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns("claims")])
    rows = stage(canonical_values(checked(rows, "claims")), "ingest-new")
    if not rows.where("provenance is null or provenance = ''").isEmpty():
        raise MissingProvenance("every claim of a batch needs its provenance")
    twice = rows.groupBy("claim_id").count().where("count > 1").select("claim_id").limit(1).collect()
    if twice:
        raise DuplicateClaim(f"{twice[0].claim_id} comes twice")

    def write(now: Snapshot) -> DataFrame | None:
        if key is not None and now.knows(key):
            return None
        t = store.tables(now)
        there = rows.join(t.claims, "claim_id", "left_semi").select("claim_id").limit(1).collect()
        if there:
            raise DuplicateClaim(f"{there[0].claim_id} is there already")
        placed = stage(known_targets(t, rows), "ingest-known")
        fresh = placed.where("known is null").drop("known")
        decided = stage(replay(t, fresh, oracle is not None), "ingest-decided")
        claims = fresh.select(*columns("claims"))
        ledger = fresh.join(decided, "claim_id").select(
            F.expr("uuid()").alias("entry_id"), "agent_id", "claim_id", F.lit("ClaimCommitted").alias("event_kind"), "disposition",
            F.to_json(F.struct("conflict_type", "route")).alias("rationale_json"), F.col("tx_time").alias("recorded_at"), F.lit(None).cast("long").alias("stream_seq"),
        )
        edges = fresh.select("agent_id", F.col("claim_id").alias("from_claim_id"), F.explode(F.array_distinct("derived_from")).alias("to_claim_id"), F.col("tx_time").alias("created_at"))
        edges = edges.select(F.expr("uuid()").alias("edge_id"), "agent_id", "from_claim_id", "to_claim_id", F.lit("DerivedFrom").alias("edge_kind"), "created_at")
        parts = {"claims": claims, "ledger": ledger, "edges": edges}
        if oracle is not None:
            parts["pending"] = _queued(fresh, decided, oracle, store.config)
        store.commit(parts, now.version, key)
        again = placed.where("known is not null").select("claim_id", F.col("known").alias("claim_ref"), F.lit("CommittedCheap").alias("disposition"), F.lit(None).cast("string").alias("contested_with"))
        return decided.select("claim_id", F.col("claim_id").alias("claim_ref"), "disposition", "contested_with").unionByName(again)

    return store.retried(write)


def _queued(fresh: DataFrame, decided: DataFrame, oracle: Callable[[str, dict], str], config: Config) -> DataFrame:
    rows = fresh.join(decided.where("disposition = 'QueuedForAdjudication'"), "claim_id").select("agent_id", "subject", "predicate", F.col("claim_id").alias("challenger_claim_id"), F.col("contested_with").alias("incumbent_claim_id"), F.col("tx_time").alias("queued_at"))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            requests = [{"subject": r["subject"], "predicate": r["predicate"], "challenger": r["challenger_claim_id"], "incumbent": r["incumbent_claim_id"]} for r in pdf.to_dict("records")]
            yield pdf.assign(request_payload_json=[canonical_json(r) for r in requests], handle_id=[oracle(a, r) for a, r in zip(pdf["agent_id"], requests)])

    shape = "agent_id string, subject string, predicate string, challenger_claim_id string, incumbent_claim_id string, queued_at timestamp_ntz, request_payload_json string, handle_id string"
    ttl = config.default_adjudication_ttl
    expires = F.lit(None).cast("timestamp_ntz") if ttl is None else (F.col("queued_at") + F.lit(ttl)).cast("timestamp_ntz")
    # Staged, as an oracle must not be asked again when the rows are read again.
    return stage(rows.mapInPandas(asked, shape), "ingest-queued").withColumn("expires_at", expires).withColumn("status", F.lit("pending")).withColumn("seq", F.lit(1).cast("long"))


def stream_into(store: ClaimStore, folder: str, checkpoint: str, oracle: Callable[[str, dict], str] | None = None) -> StreamingQuery:
    """Follows a folder of Parquet claims; every micro-batch is one commit. A micro-batch that the stream repeats after a
    failure is known by its number and not committed again."""
    claims = store.spark.readStream.schema(CLAIMS).parquet(folder)
    return claims.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: append(store, df, oracle, (checkpoint, n)) if not df.isEmpty() else None).queryName(f"claims-{uuid.uuid4().hex[:8]}").start()
