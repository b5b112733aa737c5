import random

import numpy as np
import pyarrow as pa
import pytest

from credence.llm import jaccard_join as jj
from credence.llm._common import read_table
from tests.llm.oracle import SF, assert_same


def of_three(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def brute(docs, percent, shingles=of_three):
    sets = [shingles(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [None, "", " \n", "one", "One", "two words", "TWO  words", out[0], out[0]]
    return list(enumerate(out, 1)) + [(None, out[0]), (None, "lonely null id"), (5, out[4]), (5, out[4])]


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 70), (3, 80)])
def test_brute_force(spark, seed, percent):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df, percent=percent).collect()), key=str)
    assert got == brute(docs, percent)
    kept = jj.keep_one(df, percent=percent).collect()
    words = [r for r in kept if (r.text or "").split()]
    assert len(words) == len({c for _, n, c in got if n and c is not None}) + sum(1 for _, n, c in got if n and c is None)
    assert len(kept) - len(words) == 3


def test_chain_of_links_is_one_component(spark):
    words = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(words[2 * i : 2 * i + 120])) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.component_id for r in jj.near_duplicates(df).collect()} == {0}
    assert jj.near_duplicates(df.limit(0)).count() == 0 and jj.keep_one(df.limit(0)).count() == 0


def test_sets_of_slices():
    row, item = jj.ngram_sets(pa.array(["a b c d", None, "A B c", "x", "x", "a b", "z " * 50_000]))
    assert np.bincount(row).tolist() == [2, 0, 1, 1, 1, 1, 1] and item[2] in item[:2] and item[3] == item[4]


def test_whole_table(spark):
    assert assert_same(jj.near_duplicates(read_table(spark, SF, "documents")), jj.NEAR_SQL) == 1000
