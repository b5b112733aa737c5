"""Helpers shared by the training-data operators: staging, Arrow text batches, words."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken in slices of about so many bytes, so that a worker's memory doesn't follow the batch.
SLICE_BYTES = 2 << 20
#: Bytes of rows that go to a Python worker at a time. Spark's own bound is 64 MB, of which a task holds several copies outside the
#: JVM's heap and one in its worker.
BATCH_BYTES = 4 << 20
#: Used only where the session names no shared folder, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints/credence"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_ROOT
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost nothing. The folder goes when
    the driver ends, as results may still read it until then."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(f: Callable) -> Callable:
    """f (docs, ...) with batches of BATCH_BYTES for whatever it runs, as by staged(); the session's setting is put back."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **more):
        conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key)
        conf.set(key, str(BATCH_BYTES))
        try:
            return f(docs, *args, **more)
        finally:
            conf.set(key, before)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer splits than the session has cores over all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(name: str, df: DataFrame) -> str:
    """name, with underscores added until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `size` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(lengths + 64) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def strings(array: pa.Array) -> list[str]:
    """The Python strings of an array without nulls; many times as fast as to_pylist()."""
    return array.to_numpy(zero_copy_only=False).tolist()


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space (A-Z lower-cased unless told not to), and the row of each; null texts have none."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def coded_words(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice, the code of each word occurrence, and its row."""
    flat, rows = words_of(text, lower)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a slice without nulls, and the offsets of its rows in them."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Arrays that one task adds up at most.
SUM_GROUP = 256


def summed_rows(parts: DataFrame, width: int, n_parts: int) -> dict[int, np.ndarray]:
    """Sums arrays of one width by `at`, in the order of their parts; the caller bounds the number of `at`.

    parts: at int, part int (below n_parts), sums array<double>. A tree: each group adds up SUM_GROUP arrays at most, never
    rows of the corpus, and as many groups run at a time as there are.
    """

    def add(pdf):
        pdf = pdf.sort_values("part")
        return type(pdf)({"at": pdf["at"][:1].to_numpy(), "part": pdf["part"][:1].to_numpy() // SUM_GROUP, "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    shape = "at int, part int, sums array<double>"
    while n_parts > SUM_GROUP:
        parts = parts.groupBy("at", F.floor(F.col("part") / SUM_GROUP)).applyInPandas(add, shape)
        n_parts = -(-n_parts // SUM_GROUP)
    return {r["at"]: np.asarray(r["sums"], np.float64).reshape(width) for r in parts.groupBy("at").applyInPandas(add, shape).collect()}
