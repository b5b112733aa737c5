"""One subject-line in plain Python: what a single write needs, and the yardstick for the set-based fold in tests.

A claim is a dict with the columns of `claims`, with `disposition` (its last, or None) and `assertions`, a list of
(asserted_at, assertion_id, kind, effective_at).
"""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np

from credence.schema import NON_LIVE, Config


def sure(claim: dict, config: Config) -> bool:
    return np.float32(claim["valid_time_confidence"]) >= np.float32(config.valid_time_confidence_threshold)


def trusted(claim: dict, config: Config) -> bool:
    return sure(claim, config) and claim["valid_start"] is not None


def okey(claim: dict, config: Config) -> tuple:
    start = claim["valid_start"] if trusted(claim, config) else None
    return (start or claim["tx_time"], claim["tx_time"], claim["claim_id"])


def apart(a: dict, b: dict) -> bool:
    return any(x["valid_end"] is not None and x["valid_end"] <= y["valid_start"] for x, y in ((a, b), (b, a)))


def is_live(claim: dict, as_of: dt.datetime) -> bool:
    state = "Reopen"
    for asserted, _, kind, effective in sorted(claim["assertions"]):
        if asserted <= as_of and effective <= as_of:
            state = kind
    return state == "Reopen" and claim["disposition"] not in NON_LIVE


def fold(claims: list[dict], as_of: dt.datetime, valid_at: dt.datetime | None, config: Config) -> list[dict]:
    """The live claims in canonical order, narrowed to the instant's window if they are a trusted succession."""
    live = sorted((c for c in claims if c["tx_time"] <= as_of and is_live(c, as_of)), key=lambda c: okey(c, config))
    if len(live) > 1 and all(trusted(c, config) for c in live) and all(apart(a, b) for a, b in itertools.combinations(live, 2)):
        at = valid_at or as_of
        live = [c for c in live if c["valid_start"] <= at and (c["valid_end"] is None or at < c["valid_end"])]
    return live


def status(live: list[dict]) -> str:
    conflict = sum(c["cardinality"] == "Functional" for c in live) > 1 or len(live) > 1 and any(c["cardinality"] != "SetValued" for c in live)
    if not live:
        return "NoBelief"
    if conflict or any(c["disposition"] == "Contested" for c in live):
        return "Contested"
    return "TimingUncertain" if len(live) == 1 and live[0]["valid_start"] is None and live[0]["valid_end"] is None else "Resolved"


def decide(claim: dict, live: list[dict], config: Config, oracle_present: bool) -> tuple[str, str, str]:
    """conflict type, route and disposition of a new claim against the live ones."""
    return decide_against(claim, live[0] if live else None, len(live), config, oracle_present)


def decide_against(claim: dict, first: dict | None, n_live: int, config: Config, oracle_present: bool) -> tuple[str, str, str]:
    """The same by the first live claim and their number."""
    if first is None or claim["value_json"] == first["value_json"]:
        conflict = "NoConflict"
    elif n_live == 1 and trusted(claim, config) and trusted(first, config) and apart(claim, first):
        conflict = "Succession"
    else:
        conflict = "SameLineConflict"
    start, end = claim["valid_start"], claim["valid_end"]
    if claim["provenance"] == "RecallReEntry":
        return conflict, "RecallTainted", "CommittedCheap"
    if sure(claim, config) and start is not None and (end is not None and start > end or start > claim["tx_time"]):
        return conflict, "Quarantine", "Quarantined"
    if claim["provenance"] == "ModelDerived":
        return conflict, "Inferred", "CommittedInferred"
    if conflict in ("NoConflict", "Succession"):
        return conflict, "CheapPath", "CommittedCheap"
    return conflict, "HeavyPath", "QueuedForAdjudication" if oracle_present else "Contested"
