"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, identifier and secret cues, prefixes of
known keys) in one pass over each whole text; deterministic local parsers expand every anchor to its boundaries and validate
it. Besides the base kinds there are addresses (url), accounts (an identifier after a cue, or a number of 12 to 19 digits that
stands alone, at once or in groups of four, and is no card), and secrets (a value that a cue assigns, or a known key format).

Defined cases: null text counts as empty (no spans, sha256 of the empty string); repeated rows give repeated rows; empty
tables give empty results; further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import slices, strings

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
SCHEMES = ("https", "http", "ftps", "ftp")
#: Cues after which an account or identity number may follow.
CUES = ("iban", "account", "acct", "ssn", "passport", "routing", "customer id", "member id", "user id")
#: Cues that a secret may be assigned to, and how known keys begin (in lower case).
SECRET_CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key", "bearer", "credential")
KEY_STARTS = ("akia", "ghp_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "-----begin ")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_BODY = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9]{2,}")
AFTER_CUE = re.compile(r"(?:[\x20]?(?:number|no\.?|nr\.?|#))?[\x20]?[:#=]?[\x20]?")
#: Two letters, two check digits and at most 30 more characters are what an IBAN has.
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30}")
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*(?:\x20[0-9][0-9-]*)*")
NUMBER = re.compile(r"(?:[0-9]{12,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,4}){0,2})(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"[\"']?(?:[\x20\t]*(?::=|=>|[:=])[\x20\t]*|[\x20\t]+(?:is[\x20\t]+)?)(?:\"([^\"\r\n]{8,})\"|'([^'\r\n]{8,})'|([A-Za-z0-9+/_.=~!#$%^&*-]{8,}))")
KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp_|github_pat_|sk_live_)[A-Za-z0-9_]{16,}|xox[bp]-[A-Za-z0-9-]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("://", ("url", 3))
    for cue in SECRET_CUES:
        found.add_word(cue, ("secret", len(cue)))
    for start in KEY_STARTS:
        found.add_word(start, ("key", len(start)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def valid_iban(text: str) -> bool:
    body = "".join(c for c in text if c.isalnum()).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", body):
        return False
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue: an IBAN that proves itself by its check digits, or a token with five digits or more."""
    start = AFTER_CUE.match(text, at).end()
    if start == at:
        return None
    if found := IBAN.match(text, start):
        whole = found.group()
        cuts = [m.start() for m in re.finditer(" ", whole)]
        for end in (len(whole), *reversed(cuts)):
            if valid_iban(whole[:end]):
                return start, start + end
    found = TOKEN.match(text, start)
    first = found.group().rstrip(" -") if found else ""
    return (start, start + len(first)) if len(_digits(first)) >= 5 else None


def number_at(text: str, at: int) -> tuple[int, int] | None:
    """A number of identifier length that begins here and stands alone."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "+.,-_/" or at > 1 and text[at - 1] == " " and text[at - 2].isdigit()):
        return None
    found = NUMBER.match(text, at)
    return found.span() if found and 12 <= len(_digits(found.group())) <= 19 else None


def secret_after(text: str, at: int) -> tuple[int, int] | None:
    """The value that a cue before `at` assigns: in quotes, or one word that mixes letters and digits."""
    found = ASSIGNED.match(text, at)
    if not found:
        return None
    quoted = found[1] or found[2]
    value = quoted or found[3].rstrip(".,")
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    assigns = any(c in ":=" for c in found.group()[: found.start(found.lastindex) - found.start()])
    if not (mixed and len(value) >= 8 or quoted and assigns and " " not in value):
        return None
    start = found.start(found.lastindex)
    return start, start + len(value)


def key_at(text: str, at: int) -> tuple[int, int] | None:
    """A key of a known format that begins here; a private key goes up to its end line."""
    if found := KEY.match(text, at):
        return found.span()
    if found := PEM.match(text, at):
        close = f"-----END {found[1]}-----"
        end = text.find(close, found.end())
        return (at, end + len(close)) if end >= 0 else found.span()
    return None


def url_at(text: str, at: int) -> tuple[int, int] | None:
    """The address around '://' at `at`."""
    scheme = next((s for s in SCHEMES if text[max(0, at - len(s)) : at].translate(LOWER) == s), None)
    if not scheme or at > len(scheme) and (text[at - len(scheme) - 1].isalnum() and text[at - len(scheme) - 1].isascii()):
        return None
    found = URL_BODY.match(text, at + 3)
    if not found:
        return None
    whole = found.group().rstrip(".,;:!?)]'\"")
    host = re.split(r"[/?#:]", whole, maxsplit=1)[0]
    return (at - len(scheme), at + 3 + len(whole)) if HOST.fullmatch(host) or IP.fullmatch(host) else None


def find_spans(text: str, found: ahocorasick.Automaton, lowered: str | None = None) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, end, kind); lowered: the text with A-Z lower-cased, if at hand."""
    lowered = text.translate(LOWER) if lowered is None else lowered
    spans: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)
    for last, (what, size) in found.iter(lowered):
        at = last - size + 1
        if what == "digit":
            if at >= past["ip"]:
                if m := IP.match(text, at):
                    past["ip"] = m.end()
                    if valid_ip(m.group()):
                        spans.append((at, m.end(), "ip"))
                else:
                    past["ip"] = DIGITS.match(text, at).end()
            if at >= past["card"] and (m := CARD.match(text, at)):
                past["card"] = m.end()
                if valid_card(m.group()):
                    spans.append((at, m.end(), "card"))
                    past["account"] = max(past["account"], m.end())
            if at >= past["account"] and (span := number_at(text, at)):
                past["account"] = span[1]
                spans.append((*span, "account"))
        elif what == "email":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                spans.append((start, m.end(), "email"))
        elif what == "phone":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                past["phone"] = m.end()
                if valid_phone(m.group()):
                    spans.append((at, m.end(), "phone"))
        elif what == "url":
            if at >= past["url"] and (span := url_at(text, at)):
                past["url"] = span[1]
                spans.append((*span, "url"))
        elif what in ("secret", "key"):
            if at >= past["secret"] and (not at or not lowered[at - 1].isalnum()) and (span := secret_after(text, last + 1) if what == "secret" else key_at(text, at)):
                past["secret"] = span[1]
                spans.append((*span, "secret"))
        elif (not at or not lowered[at - 1].isalnum()) and last + 1 >= past["account"] and (span := account_after(text, last + 1)):
            past["account"] = span[1]
            spans.append((*span, "account"))
    return spans


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_url long, n_account long, n_secret long, n_spans long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts by kind, the number of all spans, the digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, order = automaton(), {k: i for i, k in enumerate(KINDS)}
        empty = hashlib.sha256(b"").hexdigest()
        for part in slices(batches):
            out: dict[str, list] = {k: [] for k in ("sha", "spans", "all", *KINDS)}
            texts = pc.fill_null(part.column("text"), "")
            for text, lowered in zip(strings(texts), strings(pc.ascii_lower(texts))):
                spans = find_spans(text, found, lowered)
                if not spans:
                    for k in (*KINDS, "all"):
                        out[k].append(0)
                    out["sha"].append(empty)
                    out["spans"].append("")
                    continue
                spans.sort(key=lambda s: (s[0], order[s[2]]))
                for k in KINDS:
                    out[k].append(sum(s[2] == k for s in spans))
                out["all"].append(len(spans))
                out["sha"].append(hashlib.sha256(_joined([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest())
                out["spans"].append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in (*KINDS, "all")), pa.array(out["sha"], pa.string()), pa.array(out["spans"], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def redact(docs: DataFrame) -> DataFrame:
    """Rows with every span replaced by its kind in square brackets; overlapping spans join under the first kind."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for part in slices(batches):
            texts = []
            for value in part.column("text"):
                text, out, past = value.as_py(), [], 0
                for a, b, k in sorted(find_spans(text or "", found)):
                    if a >= past:
                        out += [text[past:a], f"[{k}]"]
                    past = max(past, b)
                texts.append(None if text is None else "".join(out) + text[past:])
            yield part.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
