"""Removal of lines that recur across sites, by distinct-site spread. DataFrame functions only.

Every line of every text is hashed (two 64-bit hashes) and a HyperLogLog sketch of the sites that carry it is merged by
aggregation. A sketch estimate well above the threshold marks a line as boilerplate, one well below clears it, and lines
near the threshold get an exact distinct count. A marked line stays in the document with the smallest id that has it and
goes from all others. Texts are cut into lines twice: once for the sketches, and once for the sites and texts of all lines
that the sketches leave, from which both the exact counts and the marked lines of each text are taken.

Defined cases: lines are compared without surrounding white space; lines of fewer than `min_words` words always stay; null
text has no lines and stays null; a text whose lines all go becomes empty; null sites count as one site of their own; null
ids come after all others; rows that repeat one id keep the line in each of them; repeats within the keeping document stay;
texts without marked lines stay as they are, byte by byte; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm._common import free_name, staged

MIN_SITES, MIN_WORDS = 5, 4
LG_K = 10
#: Estimates within this share of the threshold (at least one site) are counted exactly: over three standard errors at LG_K.
BAND = 0.15
BLANKS, WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"
LAST = 1 << 62


def line_key(line: Column) -> Column:
    """128 bits of a line without surrounding white space."""
    core = F.btrim(line, F.lit(BLANK_CHARS))
    return F.struct(F.xxhash64(core).alias("a"), F.xxhash64(F.lit(1), core).alias("b"))


def _has_words(line: Column, n: int) -> Column:
    """Whether the line has n words or more; the match ends at the n-th and never goes back over what it has taken."""
    return line.rlike(f"^{BLANKS}*+(?:{WORD}++{BLANKS}++){{{n - 1}}}{WORD}") if n > 0 else F.lit(True)


def _text_key(text: Column) -> Column:
    """Null texts are dealt by their ids, so that they don't meet in one task."""
    return F.when(text.isNull(), F.xxhash64(F.lit("null"), "doc_id")).otherwise(F.xxhash64(text))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each long enough line of each text: key, site, id, text_key."""
    return (
        docs.where(F.col("text").isNotNull())
        .select(
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("site"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
            _text_key(F.col("text")).alias("text_key"),
            F.explode(F.split("text", "\n")).alias("line"),
        )
        .where(_has_words(F.col("line"), min_words))
        .select(line_key(F.col("line")).alias("key"), "site", "id", "text_key")
    )


def marked_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """key, keeper (smallest id with the line) and sites (estimate, or exact near the threshold) of lines to remove; and key, site
    and text_key, once each, of all lines that may be among them."""
    lines = _lines(docs, min_words)
    spread = staged(
        lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("keeper"))
        .select("key", "keeper", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= min_sites - _band(min_sites)),
        "line-spread",
    )
    found = staged(lines.join(spread.select("key"), "key").select("key", "site", "text_key").distinct(), "line-found")
    sure = spread.where(F.col("estimate") > min_sites + _band(min_sites)).select("key", "keeper", F.col("estimate").alias("sites"))
    near = spread.where(F.col("estimate") <= min_sites + _band(min_sites))
    exact = (
        found.select("key", "site").join(near.select("key", "keeper"), "key").distinct()
        .groupBy("key", "keeper").agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return staged(sure.unionByName(exact.select("key", "keeper", "sites")), "line-boilerplate"), found


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """key, keeper and sites of lines to remove."""
    return marked_lines(docs, min_sites, min_words)[0]


def _band(min_sites: int) -> float:
    return max(1.0, BAND * min_sites)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, count_as: str = "__removed") -> DataFrame:
    """docs with the marked lines removed; columns stay, whatever their names, and `count_as` tells how many lines went."""
    text_key, mine, gone, kept, removed = (free_name(c, docs) for c in ("line_text_key", "line_marked", "line_goes", "line_rest", count_as))
    marked, found = marked_lines(docs, min_sites, min_words)
    # The marked lines of each distinct text; a clash of text keys only brings lines that are marked anyway.
    of_text = (
        found.select("text_key", "key").join(marked.select("key", "keeper"), "key").distinct()
        .groupBy(F.col("text_key").alias(text_key)).agg(F.collect_list(F.struct("key", "keeper")).alias(mine))
    )
    of_text = staged(of_text, "line-texts")  # a join of two dealt tables can be split where a text has very many copies
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    goes = F.transform(F.filter(mine, lambda m: m["keeper"] != id_), lambda m: m["key"])
    joined = docs.withColumn(text_key, _text_key(F.col("text"))).join(of_text, text_key, "left").withColumn(gone, goes)
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda line: ~F.array_contains(F.col(gone), line_key(line)))
    changed = F.size(gone) > 0
    return (
        joined.withColumn(kept, F.when(changed, rest))
        .withColumn(removed, F.when(changed, (F.size(lines) - F.size(kept)).cast("long")).otherwise(F.lit(0).cast("long")))
        .withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")))
        .select(*docs.columns, removed)
    )


def line_dedup_report(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: lines removed, characters left and the new text's md5."""
    removed = free_name("n_removed", docs)
    return dedup_lines(docs, min_sites, min_words, removed).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(removed).alias("n_removed"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


#: The same rows by exact counting.
LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT d.rowid AS r, coalesce('s' || source, '') AS site, coalesce(doc_id, 4611686018427387904) AS id, u.line AS line, u.pos AS pos,
         regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core,
         len(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u),
b AS (SELECT core, min(id) AS keeper FROM l WHERE words >= 4 GROUP BY core HAVING count(DISTINCT site) >= 5),
k AS (SELECT l.r, l.pos, l.line, b.core IS NOT NULL AND b.keeper <> l.id AS goes FROM l LEFT JOIN b ON l.core = b.core AND l.words >= 4),
t AS (SELECT r, count(*) FILTER (WHERE goes) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '') AS rest FROM k GROUP BY r)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed, CAST(CASE WHEN d.text IS NOT NULL THEN length(t.rest) END AS BIGINT) AS n_chars_left,
       md5(coalesce(t.rest, '')) AS text_md5
FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d LEFT JOIN t ON t.r = d.rowid
"""
