"""Four functions for tool callers: plain arguments in, plain dicts out, errors as dicts too.

The agent comes from the caller's setting; everything else of the engine stays behind these.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from credence.engine import Engine, parse_date
from credence.errors import told
from credence.functions.scalars import STATUS_REASONS


def _answers(f: Callable[..., dict]) -> Callable[..., dict]:
    @functools.wraps(f)
    def call(*args: Any, **named: Any) -> dict:
        try:
            return f(*args, **named)
        except Exception as e:  # noqa: BLE001  the caller is told what it was
            return told(e)

    return call


class Tools:
    def __init__(self, engine: Engine, agent: str):
        self.engine, self.agent = engine, agent

    @_answers
    def ingest_claim(self, subject: str, predicate: str, value: Any, provenance: str | dict, cardinality: str = "Functional", confidence_value: float = 0.9, confidence_valid_time: float = 0.9,
                     criticality: str = "Low", valid_time: dict | None = None, derived_from: list[str] | None = None) -> dict:
        """valid_time: start and end as dates. A disposition that isn't final brings its status_reason."""
        (start, start_kind), (end, end_kind) = (parse_date((valid_time or {}).get(k)) for k in ("start", "end"))
        out = self.engine.ingest(self.agent, subject, predicate, value, provenance, cardinality=cardinality, criticality=criticality, valid_start=start, valid_end=end, value_confidence=confidence_value,
                                 valid_time_confidence=confidence_valid_time if start or end else 0.0, derived_from=derived_from, start_granularity=start_kind, end_granularity=end_kind)
        return out | ({"status_reason": STATUS_REASONS[out["disposition"]]} if out["disposition"] in STATUS_REASONS else {})

    @_answers
    def query_memory(self, subject: str, predicate: str, as_of_tx_time: str | None = None, valid_at: str | None = None) -> dict:
        """The belief as of a transaction time about what was true at a valid time; both default to now."""
        belief = self.engine.belief(self.agent, subject, predicate, parse_date(as_of_tx_time)[0], parse_date(valid_at)[0])
        return {"belief": belief} | ({"status_reason": STATUS_REASONS[belief["status"]]} if belief["status"] in STATUS_REASONS else {})

    @_answers
    def reconcile(self, subject_lines: list[list[str]]) -> dict:
        return self.engine.reconcile(self.agent, [tuple(x) for x in subject_lines])

    @_answers
    def audit(self, limit: int = 50, claim_ref: str | None = None, from_tx_time: str | None = None) -> dict:
        return {"entries": self.engine.audit(self.agent, limit, claim_ref, parse_date(from_tx_time)[0])}
