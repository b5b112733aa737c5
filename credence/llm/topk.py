"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become whole numbers, floor(64 * component). Each block of candidates is an index: for every level of absolute value
(the quantised impact) a posting segment with its vectors, dimensions and impacts. A block of queries is answered by taking
the segments in descending order of impact and adding impact times weight to the scores, a segment at a time as one matrix
product. It is taken in the smallest kind of number in which all its sums are exact. After a level the rest of a vector's
score is bounded by Cauchy-Schwarz over its components not yet seen; where little is left, a proof is tried: the work stops if
the vectors whose upper bound reaches the k-th lower bound are few, and these possible members are rescored exactly. Without
such a proof all segments are taken, and the scores are then exact. Every query meets every vector, so the work grows with the
number of queries times that of vectors.

Queries (a stated set) meet candidates block by block: each block of candidates is sent once to each group of queries, and
only its k best for each query go on to the final choice.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count as padded
with zeros; ids of queries and candidates that are equal, repeated rows included, don't match; null ids take no part; rows
that repeat an id are candidates each, but one query; ties go to the smaller id; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K, QUERY_MOD = 64, 20, 20
BLOCK, GROUP = 8192, 4096
#: Components below it leave room for inner products of 2,048 of them in 64 bits.
LARGEST = 1 << 20
#: Segments hold components of one level: absolute values from LEVELS[i] up to the level above.
LEVELS = (32, 16, 8, 4, 1)
#: Queries whose scores are held at once, and the share of a block at which possible members are rescored.
BATCH, FEW = 64, 0.05
#: Share of the squared lengths that may be left when a proof is tried.
LITTLE = 0.01


class ImpactIndex:
    """Posting segments of one block of vectors, by level."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size, squares = np.abs(vectors), vectors.astype(np.float64) ** 2
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rest = []  # norm of what is left of each vector after a level
        self.hopeful = []  # whether that is little
        upper = np.iinfo(np.int64).max
        self.norm = np.sqrt(squares.sum(1).max(initial=0))
        for low in LEVELS:
            mask = (size >= low) & (size < upper)
            ids, dims = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            self.segments.append((ids, dims, np.where(mask, vectors, 0)[np.ix_(ids, dims)]))
            left = np.where(size < low, squares, 0).sum(1)
            self.rest.append(np.sqrt(left))
            self.hopeful.append(left.sum() <= LITTLE * squares.sum())
            upper = low

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact scores of its k best vectors; own: ids of the queries, ids: of the vectors."""
        order = np.argsort(ids, kind="stable")
        cuts = zip(*(np.searchsorted(ids[order], own, side).tolist() for side in ("left", "right")))
        same = [order[a:b] for a, b in cuts]
        # No sum of parts of a score exceeds the product of the norms.
        most = 1.01 * self.norm * np.sqrt((queries.astype(np.float64) ** 2).sum(1).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        segments = [(rows, dims, impacts.astype(kind)) for rows, dims, impacts in self.segments]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), BATCH):
            out += self._batch(segments, queries[at : at + BATCH], same[at : at + BATCH], ids, k)
        return out

    def _batch(self, segments: list, queries: np.ndarray, same: list[np.ndarray], ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, kind = len(self.vectors), segments[0][2].dtype
        scores, weights = np.zeros((len(queries), n), kind), queries.astype(kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        for (rows, dims, impacts), rest, hopeful in zip(segments, self.rest, self.hopeful):
            if len(rows) == n:
                scores += weights[:, dims] @ impacts.T
            elif len(rows):
                scores[:, rows] += weights[:, dims] @ impacts.T
            if not rest.any():
                possible = _reaching(scores, scores, same, k)
                row, place = np.nonzero(possible)
                return self._best(row, place, scores[row, place].astype(np.int64), len(queries), ids, k)
            if hopeful and n > k + 1 and kind != np.int64:
                slack = norms[:, None] * rest * (1 + 1e-12)
                possible = _reaching(scores - slack, scores + slack, same, k)
                if possible.sum(1).max() <= max(k, FEW * n):
                    row, place = np.nonzero(possible)
                    return self._best(row, place, (self.vectors[place] * queries[row]).sum(1), len(queries), ids, k)
        raise AssertionError("segments don't cover the vectors")  # impacts below the last level are zeros, so this can't happen with whole numbers

    def _best(self, row: np.ndarray, place: np.ndarray, score: np.ndarray, m: int, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((ids[place], -score, row))
        place, score, cuts = place[order], score[order], np.searchsorted(row, np.arange(m + 1))
        return [(place[a : min(a + k, b)], score[a : min(a + k, b)]) for a, b in zip(cuts, cuts[1:])]


def _reaching(lower: np.ndarray, upper: np.ndarray, same: list[np.ndarray], k: int) -> np.ndarray:
    """Which vectors can be among the k best of each row: all whose upper bound reaches what k lower bounds reach, the k-th of
    the largest of many parts of the row. Those in `same` are no candidates; their bounds are overwritten."""
    (m, n), least = lower.shape, np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
    for j, own in enumerate(same):
        lower[j, own] = upper[j, own] = least
    if n <= k:
        possible = np.ones((m, n), bool)
    else:
        part = max(1, n // (4 * k))
        tops = lower[:, : n // part * part].reshape(m, -1, part).max(2)
        possible = upper >= np.partition(tops, tops.shape[1] - k, axis=1)[:, -k, None]
    for j, own in enumerate(same):
        possible[j, own] = False
    return possible


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """left: one block of candidates, right: one group of queries."""
    if not len(left) or not len(right):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score", "copies")})
    left, right = left.sort_values(["vec_id", "order"], kind="stable"), right.sort_values("vec_id", kind="stable")
    width = max(left["v"].map(len).max(), right["v"].map(len).max(), 1)
    ids, own = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    found = ImpactIndex(_matrix(left["v"], width)).search(_matrix(right["v"], width), own, ids, k)
    return pd.DataFrame(
        {
            "query_id": np.repeat(own, [len(p) for p, _ in found]),
            "vec_id": np.concatenate([ids[p] for p, _ in found]),
            "score": np.concatenate([s for _, s in found]),
            "copies": left["copies"].to_numpy()[np.concatenate([p for p, _ in found]).astype(np.int64)],
        }
    )


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, whole numbers; rows that take no part are left out. A component of LARGEST or more refuses the table, as
    inner products might not fit 64 bits."""
    x = F.col("embedding").cast("array<double>")
    refused = F.raise_error(F.lit(f"a component is {LARGEST} or more in size"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * scale).cast("long")).otherwise(refused.cast("long"))).alias("v"))


def top_k(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with all other rows."""
    rows = whole_vectors(vectors)
    queries = rows.where(F.col("vec_id") % query_mod == 0).dropDuplicates(["vec_id"])
    # Rows that repeat id and vector are searched as one, and counted, so that they can't fill a block.
    rows = rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k + 1)).alias("copies")).withColumn("order", F.xxhash64("v"))
    n_rows, n_queries = rows.count(), queries.count()
    blocks, groups = max(1, -(-n_rows // BLOCK)), max(1, -(-n_queries // GROUP))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    left = rows.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long, copies long")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
