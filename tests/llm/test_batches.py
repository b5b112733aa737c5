"""Rows go to Python workers in batches of few bytes, whatever the session says, which keeps its setting."""

import pyarrow as pa
import pytest

from credence.llm import _common, jaccard_join as jj

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def noting(spark, staged, seen):
    def noted(df, label):
        seen.append(int(spark.conf.get(KEY).rstrip("b")))
        return staged(df, label)

    return noted


def test_batches_are_bounded_by_bytes_and_the_setting_is_put_back(spark):
    docs = spark.createDataFrame([(i,) for i in range(400)], "i long").coalesce(1).selectExpr("repeat('some text ', 5000) AS text")

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    read = lambda docs: [r.n for r in docs.mapInArrow(largest, "n long").collect()]
    before = spark.conf.get(KEY)
    assert max(read(docs)) > 4 * _common.BATCH_BYTES
    assert max(_common.in_small_batches(read)(docs)) < 1.1 * _common.BATCH_BYTES
    with pytest.raises(ZeroDivisionError):
        _common.in_small_batches(lambda docs: 1 // 0)(docs)
    assert spark.conf.get(KEY) == before


def test_the_join_runs_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four {i // 2}") for i in range(6)], "doc_id long, text string")
    before, seen = spark.conf.get(KEY), []
    monkeypatch.setattr(jj, "staged", noting(spark, jj.staged, seen))
    assert [r.n_links for r in jj.near_duplicates(docs).collect()] == [1] * 6
    assert seen and set(seen) == {_common.BATCH_BYTES} and spark.conf.get(KEY) == before
