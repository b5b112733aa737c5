"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The tree is domain, language, source. A token budget (a share of all tokens) goes down the tree by weights. Every node
can take at most its tokens times `max_epochs`; what a node can't take goes to its siblings by weight (water filling), and
only what all siblings together can't take shortens their parent, whose own siblings then share it. Every leaf gives the
prefix of its token stream that fills its budget: whole seeded permutations (epochs), then the first tokens of the next.
The document at the end gives part of its tokens.

The stream's order is md5(seed:epoch:doc_id), then doc_id, then the text's hash. Sums run over the first three hex digits
of the order first and over single documents only within the one bucket in which a leaf's budget ends, so a leaf with a
third of all rows is never gathered in one task.

All sums are integers: a full node takes its capacity, any other floor(budget * weight / weights left), so that up to one
token a sibling may be left over.

Defined cases: tokens are words between ASCII white space; null text has none; null language or source is the empty name;
null id is hashed as empty text; weights not named are `other`; repeated rows each count; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._common import staged


@dataclass(frozen=True)
class MixPlan:
    """Weights are whole numbers from 1. Sources weigh alike unless named."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 5, "d1": 3, "d2": 2})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 7


PLAN = MixPlan()
PATH = ("domain", "language", "site")


def domain_of(source: Column) -> Column:
    """Sources are dealt to three domains by the last character of their name."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 3).cast("string"))


def _weight(name: Column, named: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in sorted(named.items()):
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain_of(site).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"),
        site.alias("site"),
        F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("text").alias("text_key"),
    )


def _filled(nodes: DataFrame, parents: list[str], budget: Column) -> DataFrame:
    """Water filling among siblings. nodes: parents, name, cap, w; budget: the parent's. Adds `take`."""
    by_need = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("w")).asc(), "name")
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    siblings = Window.partitionBy(*parents)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("w").over(after)
    full = F.col("cap") * F.col("weights") <= F.col("left") * F.col("w")
    return (
        nodes.withColumn("left", left).withColumn("weights", weights).withColumn("full", full)
        # The first node that doesn't fill sets the level of all after it.
        .withColumn("level_left", F.max(F.when(~F.col("full"), F.struct(F.col("weights").alias("o"), F.col("left").alias("l"), F.col("weights").alias("w")))).over(siblings))
        .withColumn("take", F.when(F.col("level_left").isNull() | (F.col("weights") > F.col("level_left.w")), F.col("cap")).otherwise(F.expr("level_left.l * w div level_left.w")))
        .drop("left", "weights", "full", "level_left")
    )


def leaf_budgets(leaves: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """leaves: domain, language, site, tokens. Adds `take`, each leaf's budget in tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    tops = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    tops = tops.withColumn("sum", F.sum("tokens").over(Window.partitionBy(F.lit(1)))).withColumn("all", F.expr(f"sum * {plan.budget_percent}L div 100L"))
    tops = tops.select(F.col("domain").alias("name"), "cap", "all", _weight(F.col("domain"), plan.domains, plan.other).alias("w")).withColumn("root", F.lit(1))
    tops = _filled(tops, ["root"], F.col("all")).select(F.col("name").alias("domain"), F.col("take").alias("above"))
    mids = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(tops, "domain")
    mids = mids.select("domain", F.col("language").alias("name"), "cap", "above", _weight(F.col("language"), plan.languages, plan.other).alias("w"))
    mids = _filled(mids, ["domain"], F.col("above")).select("domain", F.col("name").alias("language"), F.col("take").alias("above"))
    low = caps.join(mids, ["domain", "language"]).select("domain", "language", F.col("site").alias("name"), "cap", "tokens", "above", _weight(F.col("site"), plan.sources, plan.other).alias("w"))
    return _filled(low, ["domain", "language"], F.col("above")).select("domain", "language", F.col("name").alias("site"), "tokens", "take")


def mix(docs: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """Per chosen row: its leaf, whole copies, and the tokens it gives in all."""
    rows = staged(_measured(docs), "mix-rows")
    leaves = rows.groupBy(*PATH).agg(F.sum("n_tokens").alias("tokens"))
    leaves = staged(leaf_budgets(leaves, plan).where("tokens > 0").withColumn("epochs", F.expr("take div tokens")).withColumn("rest", F.expr("take % tokens")), "mix-leaves")
    order = F.md5(F.concat(F.lit(f"{plan.seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.join(leaves.select(*PATH, "epochs", "rest"), list(PATH)).withColumn("place", order).withColumn("bucket", F.substring("place", 1, 3))
    so_far = Window.partitionBy(*PATH).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        dealt.groupBy(*PATH, "rest", "bucket").agg(F.sum("n_tokens").alias("held"))
        .withColumn("upto", F.sum("held").over(so_far))
        .where("upto - held < rest and upto >= rest")  # the bucket in which the leaf's rest ends
        .select(*PATH, F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("held")).alias("start"))
    )
    ends = staged(leaves.select(*PATH, "epochs", "rest").join(ends, list(PATH), "left"), "mix-ends")
    # Written, so that the join's tasks can be split where a leaf has very many rows; only end buckets are gathered after it.
    dealt = staged(rows.join(ends, list(PATH)).withColumn("place", order).withColumn("bucket", F.substring("place", 1, 3)), "mix-dealt")
    inside = F.when(F.col("end_bucket").isNull(), 0).otherwise(F.when(F.col("bucket") < F.col("end_bucket"), F.col("n_tokens")).otherwise(0))
    clear = dealt.where("end_bucket is null or bucket <> end_bucket").withColumn("part", inside.cast("long"))
    before = Window.partitionBy(*PATH).orderBy("place", F.col("doc_id").asc_nulls_first(), "text_key").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("rest") - F.col("start") - F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    ending = dealt.where("bucket = end_bucket").withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), open_)).cast("long"))
    return (
        clear.unionByName(ending)
        .select("doc_id", "domain", F.col("language").alias("lang"), F.col("site").alias("source"), "n_tokens", F.col("epochs").alias("copies"), (F.col("epochs") * F.col("n_tokens") + F.col("part")).alias("tokens_taken"))
        .where("tokens_taken > 0")
    )


#: mix() with PLAN.
MIX_SQL = r"""
WITH m AS (
  SELECT doc_id, 'd' || (ascii(right(coalesce(source, ''), 1)) % 3) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS site,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens, text
  FROM documents),
leaf AS (SELECT domain, language, site, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(4 * sum(n_tokens) AS BIGINT) AS cap FROM m GROUP BY ALL),
n1 AS (SELECT domain AS name, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS BIGINT) * 100 // 100 FROM leaf) AS above,
              CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
f1 AS (SELECT *, above - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
              CAST(sum(w) OVER (ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM n1),
g1 AS (SELECT *, max(CASE WHEN cap * ws > rest * w THEN ws END) OVER () AS lw, max(CASE WHEN cap * ws > rest * w THEN {'o': ws, 'l': rest} END) OVER () AS lv FROM f1),
t1 AS (SELECT name AS domain, CASE WHEN lw IS NULL OR ws > lw THEN cap ELSE lv.l * w // lw END AS take FROM g1),
n2 AS (SELECT leaf.domain, language AS name, CAST(sum(cap) AS BIGINT) AS cap, any_value(t1.take) AS above,
              CASE language WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS w FROM leaf JOIN t1 USING (domain) GROUP BY ALL),
f2 AS (SELECT *, above - CAST(coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
              CAST(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM n2),
g2 AS (SELECT *, max(CASE WHEN cap * ws > rest * w THEN ws END) OVER p AS lw, max(CASE WHEN cap * ws > rest * w THEN {'o': ws, 'l': rest} END) OVER p AS lv FROM f2 WINDOW p AS (PARTITION BY domain)),
t2 AS (SELECT domain, name AS language, CASE WHEN lw IS NULL OR ws > lw THEN cap ELSE lv.l * w // lw END AS take FROM g2),
n3 AS (SELECT domain, language, site AS name, tokens, cap, t2.take AS above, 1 AS w FROM leaf JOIN t2 USING (domain, language)),
f3 AS (SELECT *, above - CAST(coalesce(sum(cap) OVER (PARTITION BY domain, language ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
              CAST(sum(w) OVER (PARTITION BY domain, language ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM n3),
g3 AS (SELECT *, max(CASE WHEN cap * ws > rest * w THEN ws END) OVER p AS lw, max(CASE WHEN cap * ws > rest * w THEN {'o': ws, 'l': rest} END) OVER p AS lv FROM f3 WINDOW p AS (PARTITION BY domain, language)),
t3 AS (SELECT domain, language, name AS site, tokens, CASE WHEN lw IS NULL OR ws > lw THEN cap ELSE lv.l * w // lw END AS take FROM g3 WHERE tokens > 0),
e AS (SELECT m.*, take // tokens AS epochs, take % tokens AS rest, md5('7:' || (take // tokens) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
      FROM m JOIN t3 USING (domain, language, site)),
s AS (SELECT *, rest - CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, site ORDER BY place, doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open FROM e)
SELECT doc_id, domain, language AS lang, site AS source, n_tokens, epochs AS copies, epochs * n_tokens + greatest(0, least(n_tokens, open)) AS tokens_taken
FROM s WHERE epochs * n_tokens + greatest(0, least(n_tokens, open)) > 0
"""
