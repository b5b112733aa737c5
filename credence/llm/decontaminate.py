"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (runs of capitalised words within a sentence, as one) and units after numbers turn into
typed placeholders, all other words into their lower-cased core. A capitalised word that opens a sentence is a name if a name
follows it; else it may be one or not, and windows that begin with it are hashed both ways. Windows of `WINDOW` template tokens of documents and benchmark
items meet in a hash join, and so do windows of `MIN_TOKENS` tokens (or of the whole item, if it is shorter). Windows of one
document and item at one shift form an alignment; its slots must be consistent: a value of the item has one value in the
document. An alignment counts from `MIN_TOKENS` tokens (or the whole item, if it is shorter), by one long window or by enough
short ones, and is exact if all slots hold the item's own values, else re-parameterised. Windows with too few words to tell
them from other lists of numbers or names (fewer than half of a short window, or than `LEAST_WORDS`) match by equal values.
An item's first word may be a name or a unit by what stands before it in the document (a heading, a list number); there it
must be the same word, unless it is a capitalised word that isn't known to open sentences (`OPENERS`), so that it may well
be a name.

Defined cases: null texts have no windows; items of fewer than `SHORTEST` tokens can't be told from chance and take no
part, items of fewer than `WINDOW` tokens match as a whole; rows that repeat id and text give one result row; null ids are
kept; results have one row for each document and item, so empty tables give none; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import coded_words, slices, staged, strings

WINDOW, MIN_TOKENS, SHORTEST = 8, 13, 4
#: Words (no slots) from which a window stands for itself whatever its slots hold.
LEAST_WORDS = 4
#: Benchmark windows up to this number (8 bytes each) are sent to the tasks, which then emit only windows that can match;
#: beyond it all windows go to the join.
BROADCAST_WINDOWS = 1_000_000

#: Units that become placeholders after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles mg g kg lb lbs oz pound pounds ton tons ml l liter liters litre litres"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years"
    " mph kmh km/h hz khz mhz ghz w kw kwh v a j kj c f k % usd eur gbp dollar dollars euro euros cent cents kb mb gb tb".split()
)
#: Words that open sentences, and so are no names for being capitalised there.
OPENERS = frozenset(
    "what which who whom whose when where why how is are was were do does did has have had can could will would should may might must if in on at by for from to of with after before during while"
    " the a an and or but so as it its he she they we you i his her their our my your this that these those there here both each every all some any many few most several one two three four five six"
    " find calculate compute solve determine let given suppose consider assume prove show evaluate simplify write explain list name describe choose select estimate round add subtract multiply divide sort"
    " no not yes well then now today yesterday tomorrow next first second third last another nothing question answer".split()
)
NUMBER = re.compile(r"[-+$€£]?[0-9][0-9.,:/]*%?")
GLUED = re.compile(r"([-+$€£]?[0-9][0-9.,]*)([A-Za-z%]+)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
KIND_WORD, KIND_NUMBER, KIND_UNIT, KIND_NAME, KIND_GLUED = range(5)
PLACEHOLDERS = np.array([0, *(xxhash.xxh3_64_intdigest(f"\x00{k}") for k in ("number", "unit", "name", "number-unit"))], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_facts(word: str) -> tuple[int, int, bool, bool, bool, bool, bool]:
    """Hash of the core, kind as it stands, may be a unit, ends a sentence, is empty, opens sentences, ends with its core."""
    core = EDGES.sub("", word)
    lowered = core.lower()
    kind = KIND_WORD
    if NUMBER.fullmatch(core):
        kind = KIND_NUMBER
    elif (m := GLUED.fullmatch(core)) and m[2].lower() in UNITS:
        kind = KIND_GLUED
    elif len(core) > 1 and core[0].isupper() and core[1:].islower():
        kind = KIND_NAME
    return xxhash.xxh3_64_intdigest(lowered), kind, lowered in UNITS, word[-1:] in ".!?:" or word[-2:-1] in ".!?", not core, lowered in OPENERS, word.endswith(core)


def templates(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a slice: template hash, value hash, slot mark and row of each token, and the token's place in its text; words that
    would be names, and those that would be units, after other tokens than theirs; of the former those that may well be names."""
    words, codes, rows = coded_words(text, lower=False)
    facts = [_word_facts(w) for w in strings(words)]
    value = np.array([f[0] for f in facts], np.uint64)[codes]
    kind, unit, ends, empty, opener, closed = (np.array([f[i] for f in facts], np.int8)[codes] for i in range(1, 7))
    keep = empty == 0
    value, kind, unit, ends, rows, opener, closed = (x[keep] for x in (value, kind, unit, ends, rows, opener, closed))
    n = len(rows)
    same = np.zeros(n, bool)
    same[1:] = rows[1:] == rows[:-1]
    starts = np.ones(n, bool)
    starts[1:] = ~same[1:] | (ends[:-1] > 0)
    named = kind == KIND_NAME
    follows = np.zeros(n, bool)  # a name that the name before runs into
    follows[1:] = named[1:] & ~starts[1:] & named[:-1] & (closed[:-1] > 0) & ~(starts[:-1] & (opener[:-1] > 0))
    led = np.zeros(n, bool)
    led[:-1] = follows[1:]
    would = [named & starts & ~led, (unit > 0) & ((kind == KIND_WORD) | named & starts & ~led)]
    kind = np.where(named & starts & ~led, KIND_WORD, kind)
    if follows.any():  # a run of names is one token, with the values of all in their order
        begin = np.flatnonzero(~follows)
        within = np.arange(n) - np.repeat(begin, np.diff([*begin, n]))
        value = np.add.reduceat(value * (2 * within + 1).astype(np.uint64), begin)
        kind, unit, rows, same, opener = (x[begin] for x in (kind, unit, rows, same, opener))
        would, n = [w[begin] for w in would], len(begin)
    after_number = np.zeros(n, bool)
    after_number[1:] = same[1:] & (kind[:-1] == KIND_NUMBER)
    kind = np.where((kind == KIND_WORD) & (unit > 0) & after_number, KIND_UNIT, kind)
    token = np.where(kind == KIND_WORD, value, PLACEHOLDERS[kind])
    first = np.flatnonzero(~same)
    place = np.arange(n) - np.repeat(first, np.diff([*first, n])) if n else np.zeros(0, np.int64)
    would = [w & (kind == KIND_WORD) for w in would]
    return token, value, kind != KIND_WORD, rows, place, *would, would[0] & (opener == 0)


def window_hashes(token: np.ndarray, value: np.ndarray, slot: np.ndarray, rows: np.ndarray, sizes: list[int], begin: np.ndarray | None = None, others: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, starts and hashes of the windows of each size; windows with too few words are hashed with the values of their slots.

    begin: only windows that begin there; `token` holds for their first place and `others` for the rest.
    """
    marks = np.concatenate([[0], np.cumsum(slot, dtype=np.int64)])
    running = np.zeros(len(token) if begin is None else len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(sizes)):
            size, n = k + 1, max(len(token) - k, 0)
            if begin is None:
                running = (running[:n] ^ token[k:]) * STEP
            else:
                running = running[: np.searchsorted(begin, n)]
                begin = begin[: len(running)]
                running = (running ^ (others if k else token)[begin + k]) * STEP
            running ^= running >> np.uint64(29)
            if size not in sizes:
                continue
            if begin is None:
                at = np.flatnonzero(rows[:n] == rows[k:])
                hashes = (running[at] ^ np.uint64(size)) * STEP
            else:
                inside = rows[begin] == rows[begin + k]
                at, hashes = begin[inside], (running[inside] ^ np.uint64(size)) * STEP
            own = slot[at] if others is None else np.ones(len(at), bool)
            slots = marks[at + size] - marks[at + 1] + own
            few = np.flatnonzero(2 * (size - slots) < min(size, 2 * LEAST_WORDS))
            for j in range(size):
                hashes[few] = (hashes[few] ^ value[at[few] + j]) * STEP
                hashes[few] ^= hashes[few] >> np.uint64(29)
            yield size, at, hashes


def _windows(part: pa.RecordBatch, key: str, sizes: list[int], wanted: np.ndarray | None, whole: bool) -> pa.RecordBatch:
    """whole: windows as of benchmark items, where a short text is one window, and first words are also names or units."""
    token, value, slot, rows, place, named, unit, maybe = templates(part.column("text"))
    length = np.bincount(rows, minlength=part.num_rows)
    out: list[tuple] = []
    head = place == 0
    # Of documents, each word that opens a sentence and may be a name; of items, their first word, which else must be the same.
    forms = [(None, KIND_WORD, False), *([(maybe & head, KIND_NAME, False), (named & ~maybe & head, KIND_NAME, True), (unit & head, KIND_UNIT, True)] if whole else [(maybe, KIND_NAME, False)])]
    for first, kind, fixed in forms:
        if first is not None and not first.any():
            continue
        tokens = token if first is None else np.where(first, PLACEHOLDERS[kind], token)
        for size, at, hashes in window_hashes(tokens, value, slot, rows, sizes, None if first is None else np.flatnonzero(first), token):
            if whole:
                fits = length[rows[at]] >= size if size in (WINDOW, MIN_TOKENS) else length[rows[at]] == size
                at, hashes = at[fits], hashes[fits]
            if wanted is not None and len(at):
                near = np.searchsorted(wanted, hashes)
                fits = wanted[np.minimum(near, len(wanted) - 1)] == hashes if len(wanted) else np.zeros(len(at), bool)
                at, hashes = at[fits], hashes[fits]
            marks = slot[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), bool)
            if first is not None and len(at):
                marks[:, 0] = True
            values = value[at[:, None] + np.arange(size)][marks].view(np.int64) if len(at) else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(marks.sum(1))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            out.append((rows[at], hashes.view(np.int64), place[at], lists, length[rows[at]], np.full(len(at), size), np.full(len(at), fixed)))
    rows_, hash_, place_, slots_, length_, size_, fixed_ = zip(*out)
    at = np.concatenate(rows_)
    columns = [part.column(key).take(pa.array(at)), part.column("text_key").take(pa.array(at))]
    columns += [pa.array(np.concatenate(hash_)), pa.array(np.concatenate(place_), pa.int32()), pa.concat_arrays(slots_), pa.array(np.concatenate(length_), pa.int32()), pa.array(np.concatenate(size_), pa.int32()), pa.array(np.concatenate(fixed_))]
    return pa.RecordBatch.from_arrays(columns, names=[key, "text_key", "hash", "place", "slots", "length", "size", "fixed"])


WINDOW_COLUMNS = "text_key long, hash long, place int, slots array<long>, length int, size int, fixed boolean"


def template_windows(texts: DataFrame, key: str, sizes: list[int], wanted: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """Windows of every whole text: key, text_key, hash, place, slot values, the text's length in tokens, and whether the first slot's value is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = _windows(part, key, sizes, wanted, whole)
            if found.num_rows:
                yield found

    rows = texts.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return rows.mapInArrow(run, f"{key} long, {WINDOW_COLUMNS}")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and item that it contains: doc_id, text_key, item_id, kind, n_windows, coverage, position."""
    items = staged(template_windows(benchmark, "item_id", list(range(SHORTEST, MIN_TOKENS + 1)), whole=True), "benchmark-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [WINDOW]
    wanted = None
    hashes = items.select("hash").distinct()
    if hashes.limit(broadcast_windows + 1).count() <= broadcast_windows:
        wanted = np.sort(np.array([r["hash"] for r in hashes.collect()], np.int64).view(np.uint64))
    hits = template_windows(docs, "doc_id", sizes, wanted)
    ours = hits.select("doc_id", "text_key", "hash", F.col("place").alias("d"), F.col("slots").alias("d_slots"))
    theirs = items.select("item_id", F.col("text_key").alias("item_key"), "hash", F.col("place").alias("b"), F.col("slots").alias("b_slots"), "length", "size", "fixed")
    pairs = F.arrays_zip(F.col("b_slots").alias("b"), F.col("d_slots").alias("d"))
    aligned = (
        ours.join(theirs, "hash").where(~F.col("fixed") | (F.col("b_slots")[0] == F.col("d_slots")[0]))
        .groupBy("doc_id", "text_key", "item_id", "item_key", (F.col("d") - F.col("b")).alias("shift"), "length", "size")
        .agg(F.collect_set(F.struct("b", pairs.alias("pairs"))).alias("found"))  # of one alignment: as long as the item at most
        .withColumn("n_windows", F.size(F.array_distinct("found.b")))  # a first word may match both ways
        .withColumn("slots", F.array_distinct(F.flatten("found.pairs")))
        .where(F.size("slots") == F.size(F.array_distinct("slots.b")))
        .where(F.col("n_windows") >= F.greatest(F.lit(1), F.least(F.lit(MIN_TOKENS), F.col("length")) - F.col("size") + 1))
        .withColumn("changed", F.size(F.filter("slots", lambda s: s["b"] != s["d"])))
        .withColumn("coverage", F.col("n_windows") / (F.col("length") - F.col("size") + 1))
    )
    best = F.struct((F.col("changed") == 0).alias("exact"), "n_windows", (-F.col("shift")).alias("back"), "coverage")
    return (
        aligned.groupBy("doc_id", "text_key", "item_id").agg(F.max(best).alias("best"))
        .select("doc_id", "text_key", "item_id", F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"), F.col("best.n_windows").cast("long").alias("n_windows"), "best.coverage", (-F.col("best.back")).cast("long").alias("position"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = staged(contamination(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key")), "left_anti")
