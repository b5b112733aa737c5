import time

import numpy as np
import pytest

from credence.llm import topk
from credence.llm._common import read_table
from tests.llm.oracle import SF, assert_same


@pytest.mark.parametrize("spread", [2, 40, 400])
def test_index_equals_brute_force(spread):
    rng = np.random.default_rng(spread)
    vectors = np.rint(rng.normal(size=(600, 16)) * spread).astype(np.int64)
    vectors[100:200] = vectors[0]
    ids, own = np.arange(600) * 3, np.array([0, 3, 7, 1797])
    queries = np.concatenate([vectors[[0, 1]], vectors[:2] * 0 + 5])
    for q, (places, scores), o in zip(queries, topk.ImpactIndex(vectors).search(queries, own, ids, 20), own):
        want = sorted(((-int(s), int(i)) for s, i in zip(vectors @ q, ids) if i != o))[:20]
        assert [(-int(s), int(ids[p])) for p, s in zip(places, scores)] == want


def test_whole_table(spark):
    assert assert_same(topk.top_k(read_table(spark, SF, "embeddings")), topk.TOP_K_SQL) == 500


def test_edges(spark):
    rows = [(i, [float(i % 7), 1.5, -2.0], 1) for i in range(60)] + [(100, None, 1), (120, [1.0, None, 2.0], 1), (140, [float("nan"), 1.0, 1.0], 1), (160, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (1, [9.0, 9.0, 9.0], 1), (180, [2.0], 1), (200, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 180, 200} and not {r.vec_id for r in got} & {100, 120, 140, 160, None}
    best = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 20)
    assert best[0][1:] == (1, 64 * 64 * (6 * 9 + 13.5 - 18)) and len(best) == 20 and all(v != 20 for _, v, _ in best)
    assert {r.score for r in got if r.query_id == 200} == {0}
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 26, 1 << 20])
def test_scores_beyond_floating_point_are_exact(size):
    """Products of components below LARGEST need more than the 53 bits of a float."""
    rng = np.random.default_rng(size)
    base = rng.integers(size // 2, size, 64)
    vectors = base + rng.integers(-2, 3, (3000, 64))
    ids, own = rng.permutation(3000), np.arange(8)
    queries = base - rng.integers(0, 3, (8, 64))
    for q, (places, scores), o in zip(queries, topk.ImpactIndex(vectors).search(queries, own, ids, 20), own):
        want = sorted(((-int(s), int(i)) for s, i in zip(vectors @ q, ids) if i != o))[:20]
        assert [(-int(s), int(ids[p])) for p, s in zip(places, scores)] == want


def test_few_vectors_and_none():
    index, none = topk.ImpactIndex(np.array([[1, 2], [3, 4], [0, 0]])), topk.ImpactIndex(np.zeros((3, 0), np.int64))
    got = index.search(np.array([[1, 1], [0, -1]]), np.array([8, 9]), np.array([7, 8, 8]), 2)
    assert [(p.tolist(), s.tolist()) for p, s in got] == [([0], [3]), ([2, 0], [0, -2])]
    assert [p.tolist() for p, _ in none.search(np.zeros((1, 0), np.int64), np.array([5]), np.array([5, 4, 3]), 2)] == [[2, 1]]


def test_a_search_costs_a_few_products():
    rng = np.random.default_rng(9)
    vectors, queries = (np.floor(rng.normal(size=(n, 64)) * 8).astype(np.int64) for n in (8192, 192))
    index, ids, own = topk.ImpactIndex(vectors), np.arange(8192), -np.arange(1, 193)

    def cost(f):
        times = []
        for _ in range(3):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    plain = cost(lambda: np.argpartition(queries.astype(float) @ vectors.T.astype(float), -20, axis=1))
    assert cost(lambda: index.search(queries, own, ids, 20)) < 4 * plain
