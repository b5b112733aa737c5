"""The engine: writes through the gate into a store, reads as DataFrames, and a small everyday interface."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.errors import ClaimNotFound, DuplicateClaim, DuplicateEdge, EngineError, HandleNotFound, IncoherentDates, MissingProvenance, NotFoundError, OracleError, StaleAdjudication, StoreError, UnknownName, UnparsableDate, ValidationError, mapped, told  # noqa: F401
from credence.functions.scalars import STATUS_REASONS, canonical_json, shown_endpoint
from credence.operators import adjudication, fold, line_model, reads
from credence.operators.liveness import latest_disposition
from credence.schema import CARDINALITIES, CRITICALITIES, LINE, PROVENANCES, VERDICTS, Config, Tables
from credence.sources.staging import stage
from credence.sources.store import ClaimStore, Snapshot
from credence.streaming import ingest as batches

Oracle = Callable[[str, dict], str]


def parse_date(text: str | dt.datetime | None) -> tuple[dt.datetime | None, str | None]:
    """Instant and granularity of YYYY, YYYY-MM, YYYY-MM-DD or a full instant."""
    if text is None or isinstance(text, dt.datetime):
        return text, None if text is None else "instant"
    t = text.strip()
    for form, name, size in (("%Y-%m-%d", "day", 10), ("%Y-%m", "month", 7), ("%Y", "year", 4)):
        if len(t) == size:
            try:
                return dt.datetime.strptime(t, form), name
            except ValueError:
                pass
    try:
        at = dt.datetime.fromisoformat(t)
    except ValueError:
        raise UnparsableDate(f"{text!r}: use YYYY, YYYY-MM, YYYY-MM-DD or an instant with its zone") from None
    return (at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at), "instant"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def parse_provenance(text: str | dict | None) -> str | None:
    """The stored name of a provenance: as it is, as {"type", "kind"}, or as a text like "external:user-asserted" in any case
    and with any of - and _ between words. The part before the first colon is the type."""
    if text is None or text in PROVENANCES:
        return text
    if isinstance(text, dict):
        text = ":".join(str(text[k]) for k in ("type", "kind") if text.get(k))
    if not isinstance(text, str):
        raise ValidationError(f"a provenance is a text or a dict, not {type(text).__name__}")
    plain = lambda part: part.strip().lower().replace("-", "").replace("_", "")
    known = {tuple(map(plain, name.split("_", 1))): name for name in PROVENANCES}
    found = known.get(tuple(map(plain, text.split(":", 1))))
    if found is None:
        raise ValidationError(f"unknown provenance {text!r}: use External:UserAsserted, External:ExternalFirstHand, RecallReEntry or ModelDerived")
    return found


def with_display(claim: dict | None) -> dict | None:
    """A belief with its window's ends as text, at the precision in which they were given; open or unknown ends have none."""
    if claim is None:
        return None
    shown = {"valid_from_display": shown_endpoint(claim.get("valid_start"), claim.get("start_granularity")), "valid_until_display": shown_endpoint(claim.get("valid_end"), claim.get("end_granularity"))}
    return claim | {k: v for k, v in shown.items() if v is not None}


class Engine:
    """Readers and writers are free: a write that another one has overtaken reads again. clock: for tests."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, oracle: Oracle | None = None, clock: Callable[[], dt.datetime] = _now):
        self._open(spark, ClaimStore(spark, path, config), oracle, clock)

    def _open(self, spark: SparkSession, store: ClaimStore, oracle: Oracle | None, clock: Callable[[], dt.datetime]) -> None:
        self.spark, self.store, self.oracle, self.clock, self.config, self.is_scratch = spark, store, oracle, clock, store.config, False

    @classmethod
    def in_memory(cls, spark: SparkSession, config: Config | None = None, oracle: Oracle | None = None, clock: Callable[[], dt.datetime] = _now) -> Engine:
        """An engine on a store of its own, which goes on close()."""
        out = cls.__new__(cls)
        out._open(spark, ClaimStore.scratch(spark, config), oracle, clock)
        out.is_scratch = True
        return out

    def close(self) -> None:
        if self.is_scratch:
            self.store.drop()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def tables(self) -> Tables:
        return self.store.tables()

    # Writing

    def _line(self, t: Tables, agent: str, subject: str, predicate: str) -> list[dict]:
        """The rows of one line, with their last dispositions and assertions."""
        rows = reads.subject_line(t, agent, subject, predicate)
        ids = rows.select("claim_id")
        last = {r["claim_id"]: r["disposition"] for r in latest_disposition(reads.ledger_for_claims(t, ids)).collect()}
        stated: dict[str, list] = {}
        for r in t.assertions.join(ids, t.assertions["target_claim_id"] == ids["claim_id"], "left_semi").collect():
            stated.setdefault(r["target_claim_id"], []).append((r["asserted_at"], r["assertion_id"], r["kind"], r["effective_at"]))
        return [r.asDict() | {"disposition": last.get(r["claim_id"]), "assertions": stated.get(r["claim_id"], [])} for r in rows.collect()]

    def ingest(self, agent: str, subject: str, predicate: str, value: Any, provenance: str | None, *, cardinality: str = "Unknown", criticality: str = "Low", valid_start: dt.datetime | None = None,
               valid_end: dt.datetime | None = None, valid_time_confidence: float = 0.0, value_confidence: float = 1.0, derived_from: list[str] | None = None, start_granularity: str | None = None,
               end_granularity: str | None = None, metadata: Any = None) -> dict:
        """Stamp, firewall, classification and gate, then one commit. Returns claim_ref, disposition and contested_with."""
        provenance = parse_provenance(provenance)
        if not provenance:
            raise MissingProvenance("a claim needs its provenance")
        if cardinality not in CARDINALITIES or criticality not in CRITICALITIES:
            raise ValidationError("unknown cardinality or criticality")
        now = self.clock()
        claim = {
            "claim_id": str(uuid.uuid4()), "agent_id": agent, "subject": subject, "predicate": predicate, "value_json": canonical_json(value), "cardinality": cardinality, "provenance": provenance,
            "derivation_depth": 0, "tx_time": now, "valid_start": valid_start, "valid_end": valid_end, "valid_time_confidence": float(valid_time_confidence), "start_granularity": start_granularity,
            "end_granularity": end_granularity, "value_confidence": float(value_confidence), "criticality": criticality, "derived_from": list(derived_from or []), "metadata_json": None if metadata is None else canonical_json(metadata),
        }
        edges = [{"edge_id": str(uuid.uuid4()), "agent_id": agent, "from_claim_id": claim["claim_id"], "to_claim_id": d, "edge_kind": "DerivedFrom", "created_at": now} for d in dict.fromkeys(claim["derived_from"])]

        def write(version: Snapshot) -> tuple[str, str, dict | None]:
            t = self.store.tables(version)
            if provenance == "RecallReEntry":
                known = (derived_from or [None])[0] or next((r["claim_id"] for r in reads.injected_claims(t).where(F.col("agent_id") == agent).orderBy("first_served", "claim_id").take(1)), None)
                if known:  # nothing is written: the claim is the one that it repeats
                    return known, "CommittedCheap", None
            live = line_model.fold(self._line(t, agent, subject, predicate), now, None, self.config)
            conflict, route, disposition = line_model.decide(claim, live, self.config, self.oracle is not None)
            why = {"route": route, "conflict_type": conflict}
            self.store.commit({"claims": [claim], "ledger": self._entries([(agent, claim["claim_id"], "ClaimCommitted", disposition, why)], now), "edges": edges}, version.version)
            return claim["claim_id"], disposition, live[0] if disposition in ("Contested", "QueuedForAdjudication") else None

        ref, disposition, rival = self.store.retried(write)
        if disposition == "QueuedForAdjudication" and self.oracle is not None:
            self._ask(claim, rival, now)
        return {"claim_ref": ref, "disposition": disposition, "contested_with": [rival["claim_id"]] if rival else []}

    def _ask(self, claim: dict, rival: dict, now: dt.datetime) -> None:
        """Hands a queued claim to the oracle. Should that fail, the claim stays queued without a row, and sweep() finds it."""
        agent, subject, predicate = (claim[k] for k in LINE)
        request = {"subject": subject, "predicate": predicate, "challenger": claim["claim_id"], "incumbent": rival["claim_id"], "challenger_value": claim["value_json"], "incumbent_value": rival["value_json"], "criticality": claim["criticality"], "reason": "ExternalContradiction"}
        try:
            handle = self.oracle(agent, request)
        except Exception as e:
            raise OracleError(str(e)) from e
        ttl = self.config.default_adjudication_ttl
        self.store.commit({"pending": [{
            "handle_id": handle, "agent_id": agent, "subject": subject, "predicate": predicate, "challenger_claim_id": claim["claim_id"], "incumbent_claim_id": rival["claim_id"],
            "request_payload_json": canonical_json(request), "queued_at": now, "expires_at": now + ttl if ttl else None, "status": "pending", "seq": 1}]})

    def ingest_batch(self, new: DataFrame, key: tuple[str, int] | None = None) -> DataFrame | None:
        """Many claims (columns of claims) as ingest() would take them one by one, as one commit. The oracle runs on executors."""
        return batches.append(self.store, new, self.oracle, key)

    def _entries(self, rows: list[tuple], now: dt.datetime) -> list[dict]:
        """Ledger rows; the store numbers them in this order."""
        return [{"entry_id": str(uuid.uuid4()), "agent_id": a, "claim_id": c, "event_kind": k, "disposition": d, "rationale_json": None if why is None else canonical_json(why), "recorded_at": now, "stream_seq": i} for i, (a, c, k, d, why) in enumerate(rows)]

    def _supersede(self, t: Tables, agent: str, pairs: list[tuple[str, str]], now: dt.datetime, why: dict | None = None) -> tuple[list[tuple], list[dict]]:
        """Ledger rows and bounds for (superseded, overturning) claims, with the cascade to direct dependents."""
        rows = [(agent, gone, "ValidityAsserted", "Superseded", {"event": "supersession", "overturning_claim": by} | (why or {})) for gone, by in pairs]
        if pairs:
            df = self.spark.createDataFrame(pairs, "claim_id string, overturning string")
            rows += [(agent, r["dependent"], "DependentFlaggedPendingReview", "PendingReview", {"event": "depends_on_cascade", "superseded_parent": r["claim_id"]}) for r in adjudication.dependents(t, df).collect()]
        bounds = [{"assertion_id": str(uuid.uuid4()), "agent_id": agent, "target_claim_id": gone, "kind": "Bound", "effective_at": now, "provenance": "External_ExternalFirstHand", "value_confidence": 1.0, "valid_time_confidence": 1.0, "asserted_at": now} for gone, _ in pairs]
        return rows, bounds

    def reconcile(self, agent: str, lines: list[tuple[str, str]]) -> dict:
        """Judges the live claims of the named lines anew; an empty list does nothing."""
        if not lines:
            return {"outcomes": [], "oracle_escalations": 0}
        now = self.clock()
        wanted = self.spark.createDataFrame([(agent, s, p) for s, p in lines], "agent_id string, subject string, predicate string")

        def write(version: Snapshot) -> list:
            t = self.store.tables(version)
            found = adjudication.reconcile(t, now, wanted, self.oracle is not None).orderBy(*fold.CANONICAL).collect()  # claims of the named lines
            rows = [(agent, r["claim_id"], "AdjudicationResolved", r["decided"], {"route": r["route"], "conflict_type": r["conflict_type"]}) for r in found]
            more, bounds = self._supersede(t, agent, [(r["supersedes"], r["claim_id"]) for r in found if r["supersedes"]], now)
            self.store.commit({"ledger": self._entries(rows + more, now), "assertions": bounds}, version.version)
            return found

        found = self.store.retried(write)
        return {"outcomes": [(r["claim_id"], r["decided"]) for r in found], "oracle_escalations": sum(r["escalated"] for r in found)}

    def submit_adjudication(self, handle: str, verdict: str, evidence: Any = None) -> dict:
        """evidence: any JSON value; it goes into the rationale of the verdict's ledger rows."""
        if verdict not in VERDICTS:
            raise ValidationError("a verdict is Affirm, Deny or Unknown")
        why = {"verdict": verdict, "handle": handle} | ({} if evidence is None else {"evidence": evidence})
        return self.store.retried(lambda version: self._submit(version, handle, verdict, why))

    def _submit(self, version: Snapshot, handle: str, verdict: str, why: dict) -> dict:
        now, t = self.clock(), self.store.tables(version)
        row = next(iter(reads.pending_now(t).where((F.col("handle_id") == handle) & (F.col("status") == "pending")).collect()), None)
        if row is None:
            raise HandleNotFound(handle)
        agent, new, old = row["agent_id"], row["challenger_claim_id"], row["incumbent_claim_id"]
        if row["expires_at"] is not None and row["expires_at"] <= now:
            self.store.commit({"ledger": self._entries([(agent, new, "AdjudicationExpired", "Contested", {"handle": handle})], now), "pending": [self._status(row, "expired")]}, version.version)
            raise HandleNotFound(f"{handle} has expired")
        last = {r["claim_id"]: r["disposition"] for r in latest_disposition(t.ledger.where(F.col("claim_id") == new)).collect()}
        if last.get(new) != "QueuedForAdjudication":
            raise StaleAdjudication(handle)
        rows, bounds = [], []
        if verdict == "Unknown":
            rows = [(agent, c, "AdjudicationResolved", "Contested", why) for c in (new, old)]
        else:
            if verdict == "Affirm":
                rows = [(agent, new, "AdjudicationResolved", "CommittedCheap", why)]
            more, bounds = self._supersede(t, agent, [(old, new) if verdict == "Affirm" else (new, old)], now, why)
            rows += more
        self.store.commit({"ledger": self._entries(rows, now), "assertions": bounds, "pending": [self._status(row, "resolved")]}, version.version)
        return {"handle": handle, "verdict": verdict, "challenger": new, "incumbent": old}

    def _status(self, row, status: str) -> dict:
        return {k: row[k] for k in ("handle_id", "agent_id", "subject", "predicate", "challenger_claim_id", "incumbent_claim_id", "queued_at", "expires_at")} | {"status": status, "seq": 2}

    def sweep(self) -> int:
        """Expired and orphaned challengers go back to Contested; returns their number. Nothing of it passes the driver."""
        now = self.clock()

        def write(version: Snapshot) -> int:
            t = self.store.tables(version)
            found = stage(adjudication.sweep(t, now), "sweep")
            n = found.count()
            late = reads.list_expired(t, now)
            if n or not late.isEmpty():
                at = F.lit(now).cast("timestamp_ntz")
                ledger = found.select(F.expr("uuid()").alias("entry_id"), "agent_id", "claim_id", "event_kind", "disposition", F.to_json(F.struct("cause")).alias("rationale_json"), at.alias("recorded_at"), F.lit(None).cast("long").alias("stream_seq"))
                gone = late.withColumn("status", F.lit("expired")).withColumn("seq", F.lit(2).cast("long")).withColumn("request_payload_json", F.lit(None).cast("string"))
                self.store.commit({"ledger": ledger, "pending": gone}, version.version)
            return n

        return self.store.retried(write)

    # Reading

    def belief(self, agent: str, subject: str, predicate: str, as_of: dt.datetime | None = None, valid_at: dt.datetime | None = None) -> dict:
        now, t = self.clock(), self._of(agent, subject, predicate)
        rows = fold.beliefs(t, as_of or now, valid_at, now).collect()
        if not rows:
            return {"status": "NoBelief", "primary": None, "alternatives": [], "markers": [], "currency": "Decayed", "stale_reason": "no live claim"}
        out = rows[0].asDict(recursive=True)
        out["primary"] = with_display(out["primary"])
        out["alternatives"] = [] if out["primary"] else [with_display(r.asDict()) for r in fold.selected_claims(t, as_of or now, valid_at).orderBy(*fold.CANONICAL).collect()]
        return out

    def _of(self, agent: str, subject: str | None = None, predicate: str | None = None) -> Tables:
        t, wanted = self.tables, F.col("agent_id") == agent
        for name, value in (("subject", subject), ("predicate", predicate)):
            wanted = wanted if value is None else wanted & (F.col(name) == value)
        claims, mine = t.claims.where(wanted), F.col("agent_id") == agent
        ledger, assertions = t.ledger.where(mine), t.assertions.where(mine)
        if subject is not None:  # only what is said of these claims is aggregated
            ids = claims.select("claim_id")
            ledger = ledger.join(ids, "claim_id", "left_semi").select(*ledger.columns)
            assertions = assertions.join(ids, assertions["target_claim_id"] == ids["claim_id"], "left_semi")
        return Tables(claims, assertions, ledger, t.edges.where(mine), t.pending.where(mine), t.config)

    def subject_facts(self, agent: str, subject: str, as_of: dt.datetime | None = None, valid_at: dt.datetime | None = None) -> list[dict]:
        now = self.clock()
        return [r.asDict() for r in reads.subject_facts(self._of(agent, subject), as_of or now, valid_at, now).orderBy("predicate").collect()]

    def history(self, agent: str, subject: str, predicate: str) -> list[dict]:
        return [with_display(r.asDict()) for r in reads.history(self._of(agent, subject, predicate), self.clock()).orderBy("place").collect()]

    def current(self, agent: str, subject: str, predicate: str) -> dict | None:
        """The first current entry of the history."""
        return next((h for h in self.history(agent, subject, predicate) if h["status"] == "Current"), None)

    def claim(self, agent: str, claim_id: str) -> dict:
        rows = self.tables.claims.where((F.col("agent_id") == agent) & (F.col("claim_id") == claim_id)).take(1)
        if not rows:
            raise ClaimNotFound(claim_id)
        return rows[0].asDict()

    def adjudication(self, handle: str) -> dict:
        """One handle, whatever its status."""
        rows = reads.pending_now(self.tables).where(F.col("handle_id") == handle).take(1)
        if not rows:
            raise HandleNotFound(handle)
        return rows[0].asDict()

    def audit(self, agent: str, limit: int = 100, claim_id: str | None = None, start: dt.datetime | None = None) -> list[dict]:
        return [r.asDict() for r in reads.audit(self.tables, limit, claim_id, start, agent).collect()]

    def lineage(self, agent: str, claim_id: str) -> DataFrame:
        root = self.spark.createDataFrame([(claim_id, agent)], "claim_id string, agent_id string")
        return reads.lineage(self._of(agent).edges, root).orderBy("depth", "created_at")

    def pending(self, agent: str | None = None) -> list[dict]:
        return [r.asDict() for r in reads.list_pending(self.tables, agent).orderBy("queued_at").collect()]

    # Everyday interface

    def remember(self, agent: str, subject: str, predicate: str, value: Any, *, provenance: str = "External_UserAsserted", valid_from: str | dt.datetime | None = None, valid_until: str | dt.datetime | None = None,
                 confidence: float = 1.0, cardinality: str = "Functional", criticality: str = "Medium", derived_from: list[str] | None = None) -> dict:
        (start, start_kind), (end, end_kind) = parse_date(valid_from), parse_date(valid_until)
        if start is not None and end is not None and start >= end:
            raise IncoherentDates(f"{valid_from} is not before {valid_until}")
        out = self.ingest(agent, subject, predicate, value, provenance, cardinality=cardinality, criticality=criticality, valid_start=start, valid_end=end, value_confidence=confidence, derived_from=derived_from,
                          valid_time_confidence=confidence if start or end else 0.0, start_granularity=start_kind, end_granularity=end_kind)
        return out | {"status_reason": STATUS_REASONS.get(out["disposition"])}

    def recall(self, agent: str, subject: str, predicate: str, as_of: str | dt.datetime | None = None, valid_at: str | dt.datetime | None = None) -> dict:
        b = self.belief(agent, subject, predicate, parse_date(as_of)[0], parse_date(valid_at)[0])
        value = None if b["status"] == "Contested" or not b["primary"] else json.loads(b["primary"]["value_json"])
        candidates = [json.loads(a["value_json"]) for a in b["alternatives"]] or ([json.loads(b["primary"]["value_json"])] if b["primary"] and b["status"] == "Contested" else [])
        shown = (b["primary"] or {}) if value is not None or b["status"] != "Contested" else {}
        return {
            "status": b["status"], "value": value, "candidates": candidates, "currency": b["currency"], "markers": b["markers"], "line": dict(zip(LINE, (agent, subject, predicate))),
            "valid_from": shown.get("valid_from_display"), "valid_until": shown.get("valid_until_display"), "confidence": shown.get("value_confidence"), "provenance": shown.get("provenance"), "status_reason": STATUS_REASONS.get(b["status"]),
        }
