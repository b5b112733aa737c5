import random

import numpy as np
import pyarrow as pa
import pytest

from credence.llm import jaccard_join as jj
from tests.llm.test_jaccard_join import brute, corpus


def brute_links(docs, n, percent):
    sets = []
    for _, text in docs:
        ws = (text or "").lower().split()
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return sorted(((d, sum(linked(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (3, 5, 80)])
def test_links_within_components_too(spark, seed, n, percent):
    docs = corpus(seed) + [(1000 + i, " ".join(f"x{k}" if k != i else "other" for k in range(200))) for i in range(30)]  # near copies of each other
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links) for r in jj.near_duplicates(df, n, percent).collect()), key=str)
    assert got == brute_links(docs, n, percent) and dict(got)[1005] == 29


@pytest.mark.parametrize("changed", [10, 11])
def test_a_large_group_around_the_threshold(spark, monkeypatch, changed):
    """Copies of one text, most pairs of which are just above or just below 90 percent, in several blocks; more candidates than rows are never moved."""
    monkeypatch.setattr(jj, "BLOCK", 32)
    monkeypatch.setattr(jj, "AT_ONCE", 500)
    rng, base = random.Random(changed), [f"w{i}" for i in range(1200)]
    docs = []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(1200), changed):
            text[k] = f"x{i}-{k}"
        docs.append((i, " ".join(text)))
    docs += [(1000 + i, docs[i][1]) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jj.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == brute_links(docs, 3, 90)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs, 90)


def test_common_counts():
    lists = pa.array([[1, 2, 3], [], [3, 2, 9], [7], [1, 2, 3]], pa.list_(pa.int64()))
    got = jj.common_counts(lists, np.array([0, 1, 4]), np.array([2, 3]))
    assert got.tolist() == [[2, 0], [0, 0], [2, 0]]


def test_blocks_move_rows_in_proportion_to_a_group(spark):
    """However large the group of one n-gram or component is, a row goes to a bounded number of block pairs."""
    sizes = (200, 2_000, 40_000)
    for m in sizes:
        rows = spark.range(m).selectExpr("1L AS item", "id AS uid", "10L AS n", f"{m}L AS m")
        dealt = jj._in_blocks(rows, "item", "m")
        assert dealt.count() <= jj.BLOCKS * m
        assert dealt.select("uid", "lo", "hi").distinct().count() == dealt.count()
        met = dealt.select("lo", "hi").distinct().count()
        assert met == (1 if m <= jj.BLOCK else jj.BLOCKS * (jj.BLOCKS + 1) // 2)


def test_components_in_one_task_and_in_steps(spark, monkeypatch):
    from credence.llm import components

    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "u long, v long")
    found = []
    for at_once in (1_000_000, 0):
        monkeypatch.setattr(components, "AT_ONCE", at_once)
        found.append(sorted(map(tuple, components.connected(df).collect())))
    assert found[0] == found[1] and dict(found[0])[1060] == 1000
    assert components.connected(df.limit(0)).count() == 0
