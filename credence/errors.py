"""The errors of the engine, and what a caller is told of them."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""

    kind = "engine"


class ValidationError(EngineError):
    """A request that can't be taken."""

    kind = "validation"


class MissingProvenance(ValidationError):
    """Every claim must say where it comes from."""


class UnparsableDate(ValidationError):
    """Not a year, month, day or instant."""


class IncoherentDates(ValidationError):
    """A window must start before it ends."""


class UnknownName(ValidationError):
    """A text that is no value of its enumeration."""


class NotFoundError(EngineError):
    """What is named isn't there."""

    kind = "not_found"


class ClaimNotFound(NotFoundError):
    """No claim has this id."""


class HandleNotFound(NotFoundError):
    """No open adjudication has this handle (any more)."""


class StaleAdjudication(EngineError):
    """The challenger is no longer queued."""

    kind = "stale"


class StoreError(EngineError, RuntimeError):
    """The store refuses or fails."""

    kind = "store"


class CommitConflict(StoreError):
    """Another writer has committed in between."""

    kind = "conflict"


class DuplicateEdge(StoreError):
    """An edge is stored once."""


class DuplicateClaim(StoreError):
    """A claim is stored once."""


class OracleError(EngineError):
    """The oracle couldn't take a request."""

    kind = "oracle"


def mapped(error: BaseException) -> EngineError:
    """The error of the engine that stands for any error; its own stay as they are."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    if isinstance(error, (TypeError, ValueError)) and "Py4J" not in type(error).__name__:
        out: EngineError = ValidationError(text)
    elif "unknown value" in text:
        out = UnknownName(next((line for line in text.splitlines() if "unknown value" in line), text))
    else:
        out = StoreError(text)
    out.__cause__ = error
    return out


def told(error: BaseException) -> dict[str, str]:
    """What a tool's caller sees: kind, class and message."""
    error = mapped(error)
    return {"error": error.kind, "type": type(error).__name__, "message": str(error)}
