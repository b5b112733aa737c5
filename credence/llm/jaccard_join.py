"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Equal sets become one node. All sets are put in
one global order, rare n-grams first: n-grams that recur within a task's share are counted over all documents, and the
`ORDER_LIST` most frequent of them come last, by count; any order gives the same links, a good one gives fewer candidates.
Two nodes are candidates if an n-gram stands in the smaller one's index prefix and in the other one's probe prefix. Of
n-grams that the very same many nodes have in their prefixes, the first in the order stands for all. Length filter, positional
filter and suffix filter (fixed pivots cut the order of hashes in ranges; two sets differ by at least as many n-grams as
ranges in which one size is odd and one even; 512 ranges go along with every prefix n-gram, so that nearly all chance
candidates fall before a pair is moved, 2048 are fetched for the pairs that are left) drop candidates that can't link; the
rest is verified by whole sets.

Large groups are not expanded into all pairs, as a pair within a component can't change the components:

1. N-grams that up to `FEW` nodes have in their prefixes give all candidates at once, which are filtered and verified.
2. In turns, until one merges little (`TURNS` at most), each node meets one node of each of its other prefix n-grams, another
   one each turn, and the most promising pair that lies in two components is verified.
3. The nodes of each such n-gram that still has several components meet in pairs of blocks (`BLOCKS` of them for more than
   `BLOCK` nodes); a block pair is filtered in numpy and gives only pairs of different components that pass all filters: first the best of any two components, then,
   when these are verified, all others that still lie in two components and weren't verified before.
4. Links only join nodes of one component. Their number is counted within components, again by pairs of blocks, whose
   common n-grams are counted exactly by products of 0/1 matrices; a block pair gives one number for each node.

No candidate is dropped, and none is verified twice for the components. Steps 3 and 4 compare within a group by arithmetic
that grows with its square, but what they shuffle grows with its size (times `BLOCKS`).

Defined cases: texts without words, or null, have empty sets and link with nothing; fewer words than n make one n-gram;
null ids are no smallest id unless a component has no other; repeated rows are one node and link with each other; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm._common import coded_words, free_name, in_small_batches, slices, staged, strings
from credence.llm.components import connected

WORDS, PERCENT = 3, 90
#: N-grams at the end of the order, a bounded list (16 bytes each); its length has no effect on the links.
ORDER_LIST = 500_000
#: Occurrences within about so many n-grams of one task at which an n-gram counts as recurring.
RECURS, COUNT_AT = 3, 2_000_000
RANGES, FEW_RANGES, TURNS = 2048, 512, 4
#: Links of a turn, as a share of the nodes that have links, below which the blocks take over.
SETTLED = 0.05
#: Nodes up to which all pairs of a prefix n-gram are candidates at once; without effect on the links.
FEW = 32
#: Pairs of one node that are weighed in a turn; what is left over waits for the blocks, which leave out nothing.
WEIGHED = 6
#: Nodes up to which a group is one block, and blocks of a larger one.
BLOCK, BLOCKS = 256, 6
#: Pairs, or rows and columns, that a task compares at a time.
AT_ONCE, SIDE, COLUMNS = 1 << 16, 1024, 2048
#: Bits of the filters that spare n-grams and texts without candidates: about eight for each wanted one, but no more than
#: MOST_BITS (16 MB); false alarms only cost time, as an exact join follows.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(words)), np.uint64, len(words))


def ngram_sets(text: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each text's distinct n-grams, sorted by row and hash."""
    words, codes, rows = coded_words(text)
    token, count = word_hashes(words)[codes], len(codes)
    first = np.ones(count, bool)
    first[1:] = rows[1:] != rows[:-1]
    size = np.bincount(rows, minlength=len(text))
    starts = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        full = max(count - n + 1, 0)
        hashes = np.full(full, n, np.uint64)
        for k in range(n):
            hashes = (hashes ^ token[k : k + full]) * MIX[0]
            hashes ^= hashes >> np.uint64(31)
            hashes *= MIX[1]
            hashes ^= hashes >> np.uint64(28)
        inside = rows[:full] == rows[n - 1 :] if full else np.zeros(0, bool)
        out_rows, out = [rows[:full][inside]], [hashes[inside]]
        for short in range(1, n):  # the whole sequence as one
            at = starts[size[rows[starts]] == short]
            one = np.full(len(at), short, np.uint64)
            for k in range(short):
                one = (one ^ token[at + k]) * MIX[0]
                one ^= one >> np.uint64(31)
                one *= MIX[1]
                one ^= one >> np.uint64(28)
            out_rows.append(rows[at])
            out.append(one)
    row, item = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((item, row))
    row, item = row[order], item[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[fresh], item[fresh]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def recurring(docs: DataFrame, n: int = WORDS, keep: int = ORDER_LIST) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams among those that recur within a task's share, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            item, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= RECURS
            return pa.RecordBatch.from_arrays([pa.array(item[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["item", "n"])

        for part in slices(batches):
            held.append(ngram_sets(part.column("text"), n)[1])
            if sum(map(len, held)) >= COUNT_AT:
                yield counted()
                held = []
        if held:
            yield counted()

    top = _texts(docs).select("text").mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(keep).toArrow()
    item, count = top.column("item").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(item)
    return item[order], count[order]


def _prefix_sizes(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix with which a set looks for others, and the shorter one under which larger sets find it."""
    probe = size - -(-percent * size // 100) + 1
    index = size - -(-2 * percent * size // (100 + percent)) + 1
    return probe, np.minimum(index, probe)


ROW = "rid long, doc_id long, text_key long, n_shingles long, sig binary, prefix array<long>, n_index int, parity array<long>"


def signatures(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: its set's size, signature, rare-first prefix and range sizes. To be staged."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = shared.value
        rid = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            row, item = ngram_sets(part.column("text"), n)
            m = part.num_rows
            size = np.bincount(row, minlength=m)
            ends = np.concatenate([[0], np.cumsum(size)])
            signs = [xxhash.xxh3_128_digest(item[a:b].tobytes()) if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            often = np.zeros(len(item), np.int64)
            if len(listed):
                at = np.minimum(np.searchsorted(listed, item), len(listed) - 1)
                often = np.where(listed[at] == item, counts[at], 0)
            parity = np.zeros(m * (RANGES // 64), np.uint64)
            np.bitwise_xor.at(parity, row * (RANGES // 64) + (item >> np.uint64(59)).astype(np.int64), np.uint64(1) << ((item >> np.uint64(53)) & np.uint64(63)))
            rare_first = np.lexsort((item, often, row))
            probe, index = _prefix_sizes(size, percent)
            probe = np.where(size > 0, probe, 0)
            place = np.arange(len(item)) - np.repeat(ends[:-1], size)
            prefix = item[rare_first][place < np.repeat(probe, size)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probe)]), pa.int32()), pa.array(prefix.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + m)), part.column("doc_id"), part.column("text_key"), pa.array(size.astype(np.int64)), pa.array(signs, pa.binary()), lists,
                    pa.array(np.where(size > 0, index, 0).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * (RANGES // 64), pa.int32()), pa.array(parity.view(np.int64))),
                ],
                names=[c.split()[0] for c in ROW.split(", ")],
            )
            rid += m

    return _texts(docs).mapInArrow(run, ROW)


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Common n-grams that two sets of these sizes need: the ceiling of percent / (100 + percent) of their sum."""
    return F.floor((percent * (a + b) + (99 + percent)) / (100 + percent)).cast("long")


def _pair_filter(xn: Column, xp: Column, yn: Column, yp: Column, percent: int) -> Column:
    """Length and positional filter on sizes and places of the common n-gram; x is the smaller set."""
    most = F.least(xp, yp) + 1 + F.least(xn - xp - 1, yn - yp - 1)
    return (100 * xn >= percent * yn) & (most >= _needed(xn, yn, percent))


def _filter_bits(wanted: DataFrame, key: Column) -> np.ndarray:
    """Bits of the hashed keys that occur, packed in 64-bit words; their number is a power of two."""
    n, bits = wanted.count(), LEAST_BITS
    while bits < min(8 * n, MOST_BITS):
        bits *= 2
    places = wanted.select(F.pmod(key, F.lit(bits)).alias("place"))
    words = places.selectExpr("cast(place div 64 as int) w", "shiftleft(1L, cast(place % 64 as int)) b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _known(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key % (64 * len(bits))  # numpy's sign is pmod's
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _postings(nodes: DataFrame, few_bits, many_bits, many: bool) -> DataFrame:
    """Prefix n-grams that more than FEW nodes (many) or at least two have, with their nodes: item, uid, n, n_index, p, few
    (parities of FEW_RANGES ranges). Each n-gram is in one of both; false alarms of the filters are harmless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            item, row = lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
            keep = _known(many_bits.value, item)
            if not many:
                keep = ~keep & _known(few_bits.value, item)
            at = pa.array(row[keep])
            parity = batch.column("parity").flatten().to_numpy().reshape(batch.num_rows, RANGES // FEW_RANGES, FEW_RANGES // 64)
            few = np.bitwise_xor.reduce(parity, axis=1)[row[keep]]  # neighbouring ranges as one
            few = pa.ListArray.from_arrays(pa.array(np.arange(len(few) + 1) * (FEW_RANGES // 64), pa.int32()), pa.array(few.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[keep]), batch.column("uid").take(at), batch.column("n_shingles").take(at), batch.column("n_index").take(at), pa.array(place[keep].astype(np.int32)), few],
                names=["item", "uid", "n", "n_index", "p", "few"],
            )

    return nodes.select("uid", "n_shingles", "n_index", "prefix", "parity").mapInArrow(run, "item long, uid long, n long, n_index int, p int, few array<long>")


def _once_each(listed: DataFrame) -> DataFrame:
    """Of n-grams with the very same nodes only the first in the order, which comes first in all of them; adds m, their number."""
    alike = (F.count("*").alias("m"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("y"), F.min(F.struct("uid", "p")).alias("first"))
    kept = listed.groupBy("item").agg(*alike).where("m > 1").groupBy("m", "x", "y").agg(F.min_by("item", F.struct("first.p", "item")).alias("item")).select("item", "m")
    return listed.join(kept, "item")


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """uid and whole set of the given nodes, from their texts."""
    key = F.xxhash64("doc_id", "text_key")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(nodes, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_known(bits, batch.column("cell").to_numpy())))
            for part in slices(iter([batch])):
                row, item = ngram_sets(part.column("text"), n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(item.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), lists], names=["doc_id", "text_key", "items"])

    sets = _texts(docs).withColumn("cell", key).mapInArrow(run, "doc_id long, text_key long, items array<long>")
    key = nodes.select("uid", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    sets = sets.join(key, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("uid", "items").dropDuplicates(["uid"])
    return staged(sets, "join-sets")


def _apart(a: str, b: str | Column) -> Column:
    """Ranges in which one set has an odd and the other an even number: the sets differ by as many n-grams at least."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)


def _ends(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of table (uid) that are an end of a pair. pairs should be staged, so that Spark knows when they are few, and
    moves nothing else of the table."""
    return table.join(pairs.select(F.explode(F.array("u", "v")).alias("uid")), "uid", "left_semi")


def _suffix_filter(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """pairs u, v (staged) with the bound of their difference; those that it rules out are gone."""
    parities = _ends(parities, pairs)
    both = pairs.join(parities.toDF("u", "un", "up"), "u").join(parities.toDF("v", "vn", "vp"), "v").withColumn("apart", _apart("up", "vp"))
    return both.where(F.col("un") + F.col("vn") - F.col("apart") >= 2 * _needed(F.col("un"), F.col("vn"), percent)).drop("up", "vp")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by their whole sets."""
    sets = _ends(sets, pairs)
    both = pairs.select("u", "v").join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return staged(both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v"), "join-links")


def _rooted(nodes: DataFrame, labels: DataFrame, uid: str = "uid", root: str = "root") -> DataFrame:
    """nodes with the root of their component, by default themselves."""
    return nodes.join(labels.select(F.col("node").alias(uid), F.col("root").alias(root)), uid, "left").withColumn(root, F.coalesce(root, uid))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these: ru, rv."""
    return _rooted(_rooted(pairs, labels, "u", "ru"), labels, "v", "rv").where("ru <> rv")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    return staged(connected(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)), "join-labels")


def _in_blocks(rows: DataFrame, group: str, m: str) -> DataFrame:
    """Deals the rows of each group of more than BLOCK (m of them) in BLOCKS blocks and gives each row to all pairs of blocks that
    its block is in: lo, hi, block. So what is moved grows with the rows, whatever the size of the groups."""
    blocks = F.when(F.col(m) > BLOCK, BLOCKS).otherwise(1)
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "uid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other", m)
    return rows.repartition(F.col(group), F.col("lo"), F.col("hi")).sortWithinPartitions(group, "lo", "hi", "n", "uid")


def _whole_groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by (group, lo, hi), cut so that no group of block pairs is torn, and where these begin (and the end)."""
    held: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column(c).to_numpy() for c in (group, "lo", "hi")]
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.concat_batches([*held, batch])
        starts = cut(whole)
        held = [whole.slice(starts[-1])]
        if len(starts) > 1:
            yield whole.slice(0, starts[-1]), starts
    if held:
        yield held[0], np.array([0, held[0].num_rows])


def block_candidates(marked: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different components that share a prefix n-gram and pass all filters: u, v, apart; with best, only the
    best of any two components in a pair of blocks.

    marked: item, uid, n, n_index, p, few, root and m (nodes of the item; without it, no item has many).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_groups(batches, "item"):
            uid, n, index, p, root, block, lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("uid", "n", "n_index", "p", "root", "block", "lo", "hi"))
            parity = batch.column("few").flatten().to_numpy().view(np.uint64).reshape(-1, FEW_RANGES // 64)
            # Rows are sorted by n: the first of a pair is the smaller one, and those that are too large for it come last.
            end = np.concatenate([a + np.searchsorted(n[a:b], 100 * n[a:b] // percent, "right") for a, b in zip(cuts[:-1], cuts[1:])])
            later = np.where(p < index, end - np.arange(len(uid)) - 1, 0)
            upto = np.cumsum(later)
            found: list[tuple] = []
            at = 0
            while at < len(uid):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
                x = np.repeat(np.arange(at, stop), later[at:stop])
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop])
                at = stop
                most = np.minimum(p[x], p[y]) + 1 + np.minimum(n[x] - p[x], n[y] - p[y]) - 1
                needed = -(-percent * (n[x] + n[y]) // (100 + percent))
                keep = (root[x] != root[y]) & ((lo[x] == hi[x]) | (block[x] != block[y])) & (most >= needed)
                x, y, needed = x[keep], y[keep], needed[keep]
                apart = np.bitwise_count(parity[x] ^ parity[y]).sum(1, dtype=np.int64) if len(x) else np.zeros(0, np.int64)
                keep = n[x] + n[y] - apart >= 2 * needed
                found.append((x[keep], y[keep], apart[keep]))
            x, y, apart = map(np.concatenate, zip(*found))
            u, v = np.minimum(uid[x], uid[y]), np.maximum(uid[x], uid[y])
            if best:
                a, b = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                order = np.lexsort((v, u, apart, b, a))
                a, b = a[order], b[order]
                first = np.ones(len(a), bool)
                first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                order = order[first]
                u, v, apart = u[order], v[order], apart[order]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(apart)], names=["u", "v", "apart"])

    shape = "u long, v long, apart long"
    if "m" in marked.columns:
        return _in_blocks(marked, "item", "m").mapInArrow(run, shape)
    one = marked.withColumns({c: F.lit(0) for c in ("block", "lo", "hi")})
    return one.repartition("item").sortWithinPartitions("item", "lo", "hi", "n", "uid").mapInArrow(run, shape)


def component_labels(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """node and root of all nodes that have a link; the nodes that share a prefix n-gram; whole sets of those that were verified."""
    spark = docs.sparkSession
    several = staged(nodes.select(F.explode("prefix").alias("item")).groupBy("item").agg(F.count("*").alias("m")).where("m > 1"), "join-items")
    few_bits, many_bits = (spark.sparkContext.broadcast(_filter_bits(several.where(f"m {which} {FEW}"), F.col("item"))) for which in ("<=", ">"))
    # N-grams of few nodes give all their candidates at once; most of these share by chance, and fall here.
    pairs = block_candidates(_postings(nodes, few_bits, many_bits, False).withColumn("root", F.col("uid")), percent, False)
    pairs = staged(pairs.select("u", "v").distinct(), "join-pairs")
    listed = staged(_once_each(staged(_postings(nodes, few_bits, many_bits, True), "join-listed")), "join-shared")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("uid")).unionByName(listed.select("uid")).distinct()
    ends = staged(ends, "join-ends")
    near = staged(nodes.select("uid", "n_shingles", "parity", "doc_id", "text_key").join(ends, "uid", "left_semi"), "join-near")
    parities = near.select("uid", "n_shingles", "parity")
    sets = None
    labels = spark.createDataFrame([], "node long, root long")

    def linked(pairs: DataFrame, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        ends = near.join(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct(), "uid", "left_semi")
        more = staged(ends if sets is None else ends.join(sets.select("uid"), "uid", "left_anti"), "join-more")
        if sets is None or not more.isEmpty():
            fresh = _sets(docs, more, n)
            sets = fresh if sets is None else sets.unionByName(fresh)
        return _verified(pairs, sets, percent), sets

    tried = staged(_suffix_filter(pairs, parities, percent).select("u", "v"), "join-tried")
    if not tried.isEmpty():
        links, sets = linked(tried, None)
        labels = _merged(labels, links)
    for turn in range(TURNS):
        hubs = listed.groupBy("item").agg(F.min_by(F.struct("n", "n_index", "uid", "p", "few"), F.xxhash64(F.lit(turn), "uid", "item")).alias("hub"))
        hubs = staged(hubs, "join-hubs")
        smaller = F.struct("n", "uid") < F.struct("hub.n", "hub.uid")
        fits = F.when(smaller, (F.col("p") < F.col("n_index")) & _pair_filter(F.col("n"), F.col("p"), F.col("hub.n"), F.col("hub.p"), percent))
        fits = fits.otherwise((F.col("hub.p") < F.col("hub.n_index")) & _pair_filter(F.col("hub.n"), F.col("hub.p"), F.col("n"), F.col("p"), percent))
        alike = F.col("n") + F.col("hub.n") - _apart("few", F.col("hub.few")) >= 2 * _needed(F.col("n"), F.col("hub.n"), percent)
        stars = listed.join(hubs, "item").where(F.col("uid") != F.col("hub.uid")).where(fits).where(alike).select(F.col("uid").alias("v"), F.col("hub.uid").alias("u"))
        stars = _across(stars.distinct(), labels).select("u", "v")
        some = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(turn), "u").alias("h"), "u"))), 1, WEIGHED)  # of one node's prefix
        stars = staged(stars.groupBy("v").agg(some.alias("some")).select("v", F.explode("some.u").alias("u")), "join-stars")
        best = _suffix_filter(stars, parities, percent).groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u"))
        best = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        best = staged(best.join(tried, ["u", "v"], "left_anti"), "join-best")
        if best.isEmpty():
            break
        links, sets = linked(best, sets)
        tried = tried.unionByName(best)
        merged = links.count()
        if not merged:
            break
        labels = _merged(labels, links)
        if merged < SETTLED * labels.count():
            break

    for first in (True, False):
        marked = _rooted(listed, labels)
        mixed = marked.groupBy("item").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("item")
        mixed = staged(mixed, "join-mixed")
        pairs = block_candidates(marked.join(mixed, "item", "left_semi"), percent, first).select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
        pairs = _across(_suffix_filter(staged(pairs, "join-blocks"), parities, percent), labels)
        if first:
            a, b = F.least("ru", "rv"), F.greatest("ru", "rv")
            pairs = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.min_by(F.struct("u", "v"), F.struct("apart", "u", "v")).alias("e")).select("e.u", "e.v")
        pairs = staged(pairs.select("u", "v"), "join-rest")
        if pairs.isEmpty():
            break
        links, sets = linked(pairs, sets)
        tried = tried.unionByName(pairs)
        labels = _merged(labels, links)
    return labels, near, sets


def _link_counts(docs: DataFrame, labels: DataFrame, near: DataFrame, sets: DataFrame | None, copies: DataFrame, n: int, percent: int) -> DataFrame:
    """uid and others: rows of other nodes that each node of a component links with. copies: uid, copies."""
    sizes = labels.groupBy("root").agg(F.count("*").alias("m"))
    members = staged(labels.select(F.col("node").alias("uid"), "root").join(sizes, "root").join(copies, "uid"), "links-members")
    # Two nodes of one component link with each other.
    both = members.where("m = 2")
    of_two = both.join(both.groupBy("root").agg(F.sum("copies").alias("all")), "root").select("uid", (F.col("all") - F.col("copies")).alias("others"))
    large = members.where("m > 2")
    if large.isEmpty():
        return of_two
    rest = staged(near.join(large, "uid", "left_semi").join(sets.select("uid"), "uid", "left_anti"), "links-rest")
    if not rest.isEmpty():
        sets = sets.unionByName(_sets(docs, rest, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_groups(batches, "root"):
            out = np.zeros(batch.num_rows, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                group = batch.slice(a, b - a)
                size, rows, block = (group.column(c).to_numpy() for c in ("n", "copies", "block"))
                across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
                left, right = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("lo", "hi"))
                for i in range(0, len(left), SIDE):
                    x = left[i : i + SIDE]
                    for j in range(0 if across else i, len(right), SIDE):
                        y = right[j : j + SIDE]
                        common = common_counts(group.column("items").take(pa.array(np.concatenate([x, y]))), np.arange(len(x)), len(x) + np.arange(len(y)))
                        linked = (100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)) & (common > 0)
                        if across or i < j:
                            out[a + y] += linked.T @ rows[x]
                        else:
                            np.fill_diagonal(linked, False)
                        out[a + x] += linked @ rows[y]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out)], names=["uid", "others"])

    rows = large.join(sets, "uid").withColumn("n", F.size("items").cast("long"))
    counted = _in_blocks(rows, "root", "m").mapInArrow(run, "uid long, others long").groupBy("uid").agg(F.sum("others").alias("others"))
    return of_two.unionByName(counted)


def common_counts(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common n-grams of each left row with each right row, by products of 0/1 matrices over the n-grams of several rows."""
    item, row = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    _, code, count = np.unique(item, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    row, code = row[keep], number[code[keep]]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2^24
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        has = np.zeros((len(lists), COLUMNS), np.float32)
        has[row[a:b], code[a:b] - low] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


@in_small_batches
def near_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """Per row of docs: rid, doc_id, text_key, n_shingles, component_id, keeper (the row of its component that stays) and,
    if asked for, n_links (the other rows that it links with)."""
    rows = staged(signatures(docs, recurring(docs, n), n, percent), "join-rows")
    full = rows.where("n_shingles > 0")
    groups = full.groupBy("sig").agg(F.min("rid").alias("uid"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "rid")).alias("first"))
    groups = staged(groups, "join-groups")
    repeats = full.select("rid", "sig").join(groups.where("copies > 1").select("sig", "uid"), "sig").where("rid <> uid").select("rid")
    nodes = full.join(staged(repeats, "join-repeats"), "rid", "left_anti").withColumnRenamed("rid", "uid")
    labels, near, sets = component_labels(docs, staged(nodes.drop("sig"), "join-nodes"), n, percent)
    of_group = _rooted(groups, labels)
    of_root = of_group.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("keeper"))
    if links:
        counts = _link_counts(docs, labels, near, sets, groups.select("uid", "copies"), n, percent)
        of_group = of_group.join(counts, "uid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    more = ["n_links"] if links else []
    of_sig = staged(of_group.join(of_root, "root").select("sig", "component_id", F.col("keeper.rid").alias("keeper"), *more), "join-components")
    found = rows.select("rid", "doc_id", "text_key", "n_shingles", "sig").join(of_sig, "sig", "left")
    return (
        found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .withColumn("keeper", F.coalesce("keeper", "rid"))
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in more})
        .select("rid", "doc_id", "text_key", "n_shingles", "component_id", "keeper", *more)
    )


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and n_links."""
    return near_components(docs, n, percent, links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest id. Rows without words all stay.

    Null ids come last; of rows that repeat both id and text, which can't be told apart, one stays; columns pass through,
    whatever their names; an empty table stays empty.
    """
    id_, key, once = (free_name(c, docs) for c in ("kept_id", "kept_key", "kept_once"))
    found = staged(near_components(docs, n, percent), "join-found")
    kept = found.where("rid = keeper").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.max(F.col("n_shingles") > 0).alias(once))
    kept = staged(kept, "join-kept")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(key))
    twice = found.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if twice.isEmpty():
        return docs.join(kept, here, "left_semi")
    # Rows that repeat both id and text can't be told apart: one of them stays.
    joined = docs.join(kept, here)
    single = joined.where(once).dropDuplicates([id_, key])
    return single.unionByName(joined.where(~F.col(once))).select(*docs.columns)


#: near_duplicates() by counting the n-grams of all pairs that share one; doc_id must be unique.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = g.doc_id) AS component_id,
       (SELECT count(*) FROM l WHERE l.a = g.doc_id) AS n_links FROM g
"""
