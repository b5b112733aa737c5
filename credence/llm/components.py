"""Connected components of an edge list: of a short one in one task, of a longer one by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import staged


#: Edges that one task takes (16 bytes each, and about as much again for their nodes).
AT_ONCE = 1_000_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the smallest node of the component of each."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = code[: len(u)], code[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if np.array_equal(low, high):
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        node, root = roots_of(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return row[0], row[1]


def connected(links: DataFrame) -> DataFrame:
    """links: u, v. Returns node, root for every node that has a link; root is the smallest node of its component.

    Every step joins nodes with the smallest neighbour of each, so a node with very many neighbours is only ever
    aggregated (with partial sums) and joined to one row.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-edges")
    if edges.count() <= AT_ONCE:
        return edges.coalesce(1).mapInArrow(_solved, "node long, root long")
    seen = _print(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
