"""Tables, enumerations and settings of the claim store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values.
CARDINALITIES = ("Functional", "SetValued", "Unknown")
CRITICALITIES = ("Low", "Medium", "High", "Critical")  # in rising order
PROVENANCES = ("External_UserAsserted", "External_ExternalFirstHand", "RecallReEntry", "ModelDerived")
DISPOSITIONS = (
    "CommittedCheap", "CommittedInferred", "QueuedForAdjudication", "Contested", "PendingConflict", "PendingReview",
    "PendingLowConfidence", "Quarantined", "Superseded", "Invalidated", "Reinstated", "Rejected",
)
NON_LIVE = ("Quarantined", "Superseded", "Invalidated", "Rejected")
EVENT_KINDS = (
    "ClaimCommitted", "ValidityAsserted", "AdjudicationRequested", "AdjudicationResolved", "RecallReEntryDetected",
    "Quarantined", "DependentFlaggedPendingReview", "ServedAsInjected", "AdjudicationExpired",
)
EDGE_KINDS = ("DerivedFrom", "Supersedes", "DependsOn", "MutualExclusion")
ASSERTION_KINDS = ("Bound", "Reopen")
STATUSES = ("Resolved", "Contested", "Conflict", "TimingUncertain", "NoBelief")
CURRENCIES = ("Fresh", "AgingUnconfirmed", "Decayed")
MARKERS = ("Contested", "PendingConflict", "PendingReview", "AgedSetMember", "RecallTainted", "LowDerivationAnchor")
GRANULARITIES = ("year", "month", "day", "instant")
VERDICTS = ("Affirm", "Deny", "Unknown")
PENDING_STATES = ("pending", "resolved", "expired")

LINE = ("agent_id", "subject", "predicate")
#: Ancestry is followed through so many levels.
LINEAGE_LEVELS = 64


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


CLAIMS = (
    "claim_id string, agent_id string, subject string, predicate string, value_json string, cardinality string, provenance string,"
    " nearest_external_anchor_id string, derivation_depth int, tx_time timestamp_ntz, valid_start timestamp_ntz, valid_end timestamp_ntz,"
    " valid_time_confidence float, start_granularity string, end_granularity string, value_confidence float, criticality string,"
    " derived_from array<string>, metadata_json string, snapshot_schema_version int, embedding_model_id string"
)
ASSERTIONS = (
    "assertion_id string, agent_id string, target_claim_id string, kind string, effective_at timestamp_ntz, provenance string,"
    " value_confidence float, valid_time_confidence float, asserted_at timestamp_ntz"
)
LEDGER = "entry_id string, agent_id string, claim_id string, event_kind string, disposition string, rationale_json string, recorded_at timestamp_ntz, stream_seq long"
EDGES = "edge_id string, agent_id string, from_claim_id string, to_claim_id string, edge_kind string, created_at timestamp_ntz"
PENDING = (
    "handle_id string, agent_id string, subject string, predicate string, challenger_claim_id string, incumbent_claim_id string,"
    " request_payload_json string, queued_at timestamp_ntz, expires_at timestamp_ntz, status string, seq long"
)
SCHEMAS = {"claims": CLAIMS, "assertions": ASSERTIONS, "ledger": LEDGER, "edges": EDGES, "pending": PENDING}
#: Columns whose texts are values of an enumeration.
ENUMS = {
    "claims": {"cardinality": CARDINALITIES, "provenance": PROVENANCES, "criticality": CRITICALITIES},
    "assertions": {"kind": ASSERTION_KINDS, "provenance": PROVENANCES},
    "ledger": {"event_kind": EVENT_KINDS, "disposition": DISPOSITIONS},
    "edges": {"edge_kind": EDGE_KINDS},
    "pending": {"status": PENDING_STATES},
}


@dataclass(frozen=True)
class Config:
    valid_time_confidence_threshold: float = 0.7
    aging_unconfirmed_threshold_days: int = 30
    decayed_threshold_days: int = 90
    derivation_depth_cap_for_currency_boost: int = 3
    derivation_depth_cap_for_overturning: int = 2
    quarantine_burst_threshold: int = 10
    default_adjudication_ttl: dt.timedelta | None = None


@dataclass(frozen=True)
class Tables:
    """The five tables as DataFrames. pending holds status events; the current row of a handle is its last."""

    claims: DataFrame
    assertions: DataFrame
    ledger: DataFrame
    edges: DataFrame
    pending: DataFrame
    config: Config = field(default_factory=Config)
