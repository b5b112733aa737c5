"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of each whole text (character classes, words, repetition, sentence starts) are standardised and mapped to
`FEATURES` random cosines, which approximate a Gaussian kernel. Every task sums its part of the normal equations over the
labelled rows, the sums meet by row of the matrix, and the driver solves one system of fixed size. Folds 1 to 3 of the
labelled rows fit the scores and fold 4 calibrates them: scores are rounded to bins of 0.001, counted over all rows of the
fold, and pooled until they rise (isotonic regression). Fold 0 is held out. Labels, language, source and id are no inputs.

Defined cases: null text counts as empty and is scored; null doc_id counts as empty text for its fold and meets no label;
several labels of one id are averaged; labels other than 0 and 1 are ignored; without labels every score is 0.5; repeated
rows give repeated rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import coded_words, crc_bucket, slices, staged, summed_rows, text_bytes

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3
FEATURES, WIDTH, RIDGE, SEED = 512, 4.0, 1e-3, 20240607
BINS, BIN = 3001, 1000  # raw scores from -1 to 2

# Character classes of single bytes.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, SHOUT, BAR, SYMBOL, PUNCT, LEAD, TAIL = range(13)
CLASSES = np.full(256, PUNCT, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = LOWER, UPPER, DIGIT
CLASSES[[32, 9]], CLASSES[[10, 11, 12, 13]] = SPACE, NEWLINE
CLASSES[[46, 63]], CLASSES[44], CLASSES[33], CLASSES[124] = STOP, COMMA, SHOUT, BAR
CLASSES[list(b"#$%&*+/<=>@\\^_`{}~[]")] = SYMBOL
CLASSES[0xC0:], CLASSES[0x80:0xC0] = LEAD, TAIL


def statistics(text: pa.Array) -> np.ndarray:
    """One row of document statistics for each text of a slice."""
    text, n = pc.fill_null(text, ""), len(text)
    data, offsets = text_bytes(text)
    kinds, size = CLASSES[data], np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    by_kind = np.bincount(owner * 16 + kinds, minlength=16 * n).reshape(n, 16).astype(np.float64)

    def count(mask: np.ndarray, shift: int) -> np.ndarray:
        """Of marks over neighbouring bytes of one text."""
        same = owner[shift:] == owner[: len(owner) - shift] if shift else True
        return np.bincount(owner[: len(mask)][mask & same], minlength=n).astype(np.float64)

    blank = (kinds == SPACE) | (kinds == NEWLINE)
    letter_up, letter_low = kinds == UPPER, kinds == LOWER
    after_stop = count((kinds[:-2] == STOP) & blank[1:-1] & letter_low[2:], 2) if len(kinds) > 2 else np.zeros(n)
    inside = count((letter_low[:-2] | (kinds[:-2] == COMMA)) & (kinds[1:-1] == SPACE) & letter_up[2:], 2) if len(kinds) > 2 else np.zeros(n)
    camel = count(letter_low[:-1] & letter_up[1:], 1) if len(kinds) > 1 else np.zeros(n)

    words, codes, rows = coded_words(text)
    n_words = np.bincount(rows, minlength=n).astype(np.float64)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)[codes] if len(words) else np.zeros(0)
    each, repeats = np.unique(rows * (len(words) + 1) + codes, return_counts=True)
    doc = each // (len(words) + 1)
    distinct = np.bincount(doc, minlength=n).astype(np.float64)
    most = np.zeros(n)
    np.maximum.at(most, doc, repeats)
    pair = (codes[:-1] * (len(words) + 1) + codes[1:])[rows[:-1] == rows[1:]] if len(codes) > 1 else np.zeros(0, np.int64)
    pair_doc = rows[:-1][rows[:-1] == rows[1:]] if len(codes) > 1 else np.zeros(0, np.int64)
    order = np.lexsort((pair, pair_doc))
    fresh = np.ones(len(pair), bool)
    if len(pair) > 1:
        fresh[1:] = (pair[order][1:] != pair[order][:-1]) | (pair_doc[order][1:] != pair_doc[order][:-1])
    pairs = np.bincount(pair_doc[order][fresh], minlength=n).astype(np.float64) if len(pair) else np.zeros(n)

    some, chars, letters = np.maximum(n_words, 1), np.maximum(size, 1), np.maximum(by_kind[:, LOWER] + by_kind[:, UPPER] + by_kind[:, LEAD], 1)
    mean = np.bincount(rows, length, minlength=n) / some
    first = np.where(size > 0, kinds[np.minimum(offsets[:-1], max(len(kinds) - 1, 0))] if len(kinds) else 99, 99)
    last = np.where(size > 0, kinds[np.maximum(offsets[1:] - 1, 0)] if len(kinds) else 99, 99)
    columns = [
        np.log1p(size), np.log1p(n_words), mean,
        np.sqrt(np.maximum(np.bincount(rows, length**2, minlength=n) / some - mean**2, 0)),
        by_kind[:, UPPER] / letters, by_kind[:, DIGIT] / chars, by_kind[:, PUNCT] / chars, by_kind[:, SYMBOL] / chars,
        np.log1p(by_kind[:, SHOUT]) / np.log1p(some), by_kind[:, SHOUT] / some, by_kind[:, BAR] / some, by_kind[:, NEWLINE] / some,
        by_kind[:, STOP] / some, by_kind[:, COMMA] / some, by_kind[:, LEAD] / letters,
        distinct / some, distinct / some**0.8, most / some, pairs / np.maximum(n_words - 1, 1),
        np.bincount(rows, length >= 20, minlength=n) / some, np.bincount(rows, length == 1, minlength=n) / some, np.bincount(rows, length <= 3, minlength=n) / some,
        after_stop / np.maximum(by_kind[:, STOP], 1), inside / some, camel / some,
        (first == UPPER) | (first == LEAD), last == STOP, n_words < 20,
    ]
    return np.column_stack([np.asarray(c, np.float64) for c in columns])


N_STATISTICS = 28


@dataclass(frozen=True)
class Model:
    """Fixed in size, whatever the corpus: standardisation, ridge weights and the calibrated score of each bin."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    calibrated: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return cosines(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else self.calibrated[bins_of(self.raw(stats))]


def cosines(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(stats.shape[1], FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(stats))])


def bins_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((raw + 1) * BIN), 0, BINS - 1).astype(np.int64)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The rising step function of least squares over the bins; bins without rows take the step below, the first ones the first step."""
    blocks: list[list[float]] = []  # rows, good ones, first bin
    for i in np.flatnonzero(total):
        blocks.append([total[i], good[i], i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
    out = np.full(len(total), 0.5)
    for k, (rows, ones, start) in enumerate(blocks):
        out[0 if k == 0 else int(start) :] = ones / rows
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold and statistics of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stats = statistics(part.column("text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "stats"])

    return rows.mapInArrow(run, "doc_id long, stats array<float>").withColumn("fold", crc_bucket(F.col("doc_id"), FOLDS).cast("int"))


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("stats").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, N_STATISTICS)


def _sums(rows: DataFrame, make, schema: str = "at int, part int, sums array<double>") -> DataFrame:
    """make(batches) gives the matrix that a task sums; each of its rows is sent on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(b for b in batches if b.num_rows)
        if total is not None:
            n, part = len(total), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "part", "sums"])

    return rows.mapInArrow(run, schema)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: document_statistics(), staged. labels: doc_id, quality."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = staged(stats.where(f"fold <> {HELD_OUT}").join(marked, "doc_id").select("fold", "stats", "y"), "quality-known")
    parts = known.rdd.getNumPartitions()

    def moments(batches):
        out = None
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), _matrix(b)])
            out = (0 if out is None else out) + np.stack([x.sum(0), (x**2).sum(0)])
        return out

    first = summed_rows(_sums(known, moments), N_STATISTICS + 1, parts)
    if not first:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), None, np.full(BINS, 0.5))
    n = first[0][0]
    mean = first[0][1:] / n
    scale = np.sqrt(np.maximum(first[1][1:] / n - mean**2, 0)) + 1e-6

    def equations(batches):
        out = None
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                piece = b.slice(at, 2000)
                z = cosines(_matrix(piece), mean, scale)
                y = piece.column("y").to_numpy(zero_copy_only=False)
                out = (0 if out is None else out) + z.T @ np.column_stack([z, y])
        return out

    d = FEATURES + 1
    rows = summed_rows(_sums(known.where(f"fold <> {CALIBRATION}"), equations), d + 1, parts)
    both = np.stack([rows.get(i, np.zeros(d + 1)) for i in range(d)])
    weights = np.linalg.solve(both[:, :d] + RIDGE * max(both[d - 1, d - 1], 1) * np.eye(d) / FEATURES, both[:, d])
    model = Model(mean, scale, weights, np.zeros(BINS))

    def counts(batches):
        out = None
        for b in batches:
            at, y = bins_of(model.raw(_matrix(b))), b.column("y").to_numpy(zero_copy_only=False)
            out = (0 if out is None else out) + np.stack([np.bincount(at, minlength=BINS).astype(np.float64), np.bincount(at, y, minlength=BINS)])
        return out

    steps = summed_rows(_sums(known.where(f"fold = {CALIBRATION}"), counts), BINS, parts)
    calibrated = isotonic(steps[0], steps[1]) if steps else np.clip((np.arange(BINS) / BIN) - 1, 0, 1)
    return Model(mean, scale, weights, calibrated)


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                score = model.score(_matrix(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.equal(part.column("fold"), HELD_OUT), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = staged(document_statistics(docs), "quality-statistics")
    return scores(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier fitted to them doesn't reject, with all their columns."""
    model = fit(staged(document_statistics(docs), "quality-statistics"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.score(statistics(part.column("text")).astype(np.float32).astype(np.float64)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
