"""Every stage on its own input against a brute-force version."""

import re
from collections import defaultdict

import corpus_pipeline
from credence.llm import quality
from credence.llm._common import read_table, staged
from tests.llm.test_jaccard_join import brute


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF), "test"))
    columns = docs.columns
    assert all(d.columns == columns for d in seen[:5])
    start, good, lines, near, clean, _ = [{r.doc_id: r for r in d.collect()} for d in seen]

    predicted = {r.doc_id: r.predicted for r in quality.quality_scores(docs, read_table(spark, SF, "labels")).collect()}
    assert good == {k: r for k, r in start.items() if predicted[k]}

    sites, first = defaultdict(set), {}
    for k, r in good.items():
        for line in r.text.split("\n"):
            core = line.strip(" \t\n\x0b\x0c\r")
            if len(re.findall(r"[^\x20\x09-\x0D]+", core)) >= 4:
                sites[core].add(r.source)
                first[core] = min(first.get(core, k), k)
    for k, r in good.items():
        cores = [(line, line.strip(" \t\n\x0b\x0c\r")) for line in r.text.split("\n")]
        assert lines[k].text == "\n".join(line for line, c in cores if len(sites.get(c, ())) < 5 or first[c] == k)
        assert lines[k].n_chars == (r.n_chars if lines[k].text == r.text else len(lines[k].text))

    groups = brute([(k, r.text) for k, r in lines.items()], 80, shingles)  # five words, 80 percent
    assert near == {k: lines[k] for k, n, c in groups if not n or c == k}

    items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    assert clean == {k: r for k, r in near.items() if not any(t in r.text for t in items)}
    mixed = seen[5].toPandas()
    assert set(mixed.doc_id) <= set(clean) and abs(mixed.tokens_taken.sum() - sum(len(r.text.split()) for r in clean.values())) < 300


def test_empty(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0
