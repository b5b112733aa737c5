import re

from pyspark.sql import functions as F

from credence.llm import line_dedup
from credence.llm._common import read_table
from tests.llm.oracle import SF, assert_same

ROWS = (
    [(i, f"own line number {i} of all\n  shared boiler plate line \n\nshort one", f"s{i % 7}", i) for i in range(20)]
    + [(100, None, "s1", 0), (101, "", None, 0), (None, "shared boiler plate line\nshared boiler plate line", None, 0), (3, "shared boiler plate line", "s3", 1)]
    + [(200 + i, "near the threshold line", f"s{i}", 0) for i in range(5)]
    + [(300 + i, "just below the threshold", f"s{i % 4}", 0) for i in range(40)]
    + [(400, "long words " * 30_000, "s1", 5)]
)


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, key int")


def test_small_against_exact_sql(spark):
    d = docs(spark)
    assert assert_same(line_dedup.line_dedup_report(d), line_dedup.LINE_DEDUP_SQL, documents=d) == len(ROWS)


def test_texts_and_columns(spark):
    out = line_dedup.dedup_lines(docs(spark))
    assert out.columns == ["doc_id", "text", "source", "key", "__removed"]
    got = {r.doc_id: r for r in out.collect() if r.doc_id != 3}
    assert got[0].text == ROWS[0][1] and got[5].text == "own line number 5 of all\n\nshort one"
    assert got[None].text == "" and got[None]["__removed"] == 2 and got[100].text is None
    assert got[200].text and got[204].text == "" and got[300].text == got[339].text
    assert line_dedup.dedup_lines(docs(spark).limit(0)).count() == 0


def test_whole_table(spark):
    assert_same(line_dedup.line_dedup_report(read_table(spark, SF, "documents")), line_dedup.LINE_DEDUP_SQL)


def test_no_python_in_the_plan(spark):
    plan = line_dedup.line_dedup_report(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_cut_into_lines_twice(spark, monkeypatch):
    """For the sketches, and for the lines that these leave; not once more for exact counts and once more for what to remove."""
    staged, cuts = line_dedup.staged, []

    def noted(df, label):
        cuts.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate"))
        return staged(df, label)

    monkeypatch.setattr(line_dedup, "staged", noted)
    out = line_dedup.line_dedup_report(docs(spark))
    cuts.append(out._jdf.queryExecution().optimizedPlan().toString().count("Generate"))
    assert sum(cuts) == 2 and out.count() == len(ROWS)


def test_words_and_ends_of_odd_lines(spark):
    blanks = " \t\x0b\x0c\r"
    lines = ["", " ", "a", "a b c d", " a b c d", "a b c", "a b c ", "\u00a0a b c", "a\u2003b c d", "a b\x0bc\x0cd\r", "\r\r", "\x85a b c d\x85", "x" * 50_000, "x" * 50_000 + " y z w", "é ü 漢 😀 ", blanks + "a" + blanks + "b"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    for n in (0, 1, 2, 4, 5):
        got = rows.select("line", line_dedup._has_words(rows.line, n).alias("has"), (line_dedup.line_key(rows.line) == line_dedup.line_key(F.lit("a b c d"))).alias("same")).collect()
        assert [r.has for r in got] == [len(re.findall("[^ \t-\r]+", x)) >= n for x in lines]
        assert [r.same for r in got] == [x.strip(" \t\n\x0b\x0c\r") == "a b c d" for x in lines]
