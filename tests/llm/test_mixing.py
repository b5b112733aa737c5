from credence.llm import mixing
from credence.llm._common import read_table
from tests.llm.oracle import SF, assert_same


def test_whole_table(spark):
    assert assert_same(mixing.mix(read_table(spark, SF, "documents")), mixing.MIX_SQL) > 100


def test_edges(spark):
    rows = [(i, "w " * (i % 9), "en" if i % 3 else "fr", f"src{i % 5}", 1) for i in range(200)]
    rows += [(None, "a b", None, None, 1), (7, None, "en", "src1", 2), (9, "x " * 40_000, "es", "src2", 3), (9, "x " * 40_000, "es", "src2", 3), (1000, "solo", "de", "zz", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int")
    assert_same(mixing.mix(docs), mixing.MIX_SQL, documents=docs)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 1000), ("d0", "en", "b", 10), ("d0", "de", "c", 1000), ("d1", "en", "d", 1000)], "domain string, language string, site string, tokens long")
    plan = mixing.MixPlan(domains={"d0": 1, "d1": 1}, languages={"en": 1, "de": 1}, budget_percent=20, max_epochs=1)
    take = {r.site: r["take"] for r in mixing.leaf_budgets(leaves, plan).collect()}
    assert take == {"a": 140, "b": 10, "c": 150, "d": 301}  # of 602: halves, halves of 301, and what b can't take goes to a
