"""Append-only commit log on Parquet.

A commit writes its rows to a folder of its own and then creates the next numbered manifest, which must not exist yet. Readers
take the folders that manifests name, so a commit is seen whole or not at all, and a failed one leaves no trace in any table.
A writer names the version that it has read; if another commit came in between, its own is refused and it must read again
(`retried`). A commit may carry a key, as a stream's micro-batch does (its source, and a number that rises); what is known
already is not committed twice.

Every `CHECKPOINT_EVERY` commits a checkpoint file sums up all manifests so far, so that a reader opens a bounded number of
small files. compact() writes each table anew in few files, as a commit that replaces all folders before it; old folders
stay for readers that still use them, until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.errors import CommitConflict, DuplicateEdge
from credence.functions.scalars import known_granularity
from credence.schema import ENUMS, SCHEMAS, Config, Tables
from credence.sources.staging import shared_root

CHECKPOINT_EVERY, RETRIES = 64, 20
EDGE = ["agent_id", "from_claim_id", "to_claim_id", "edge_kind"]
T = TypeVar("T")


@dataclass
class Snapshot:
    """What a version of the store consists of: folders by table, and the last number of each source of keyed commits."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    keys: dict[str, int] = field(default_factory=dict)

    def add(self, manifest: dict) -> None:
        self.version = manifest["number"] + 1
        if manifest.get("replaces"):
            self.folders = {}
        for table, path in manifest["tables"].items():
            self.folders.setdefault(table, []).append(path)
        if manifest.get("key") is not None:
            source, number = manifest["key"]
            self.keys[source] = max(number, self.keys.get(source, number))

    def knows(self, key: tuple[str, int]) -> bool:
        return key[0] in self.keys and key[1] <= self.keys[key[0]]


class ClaimStore:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.root}/_commits").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))

    @classmethod
    def scratch(cls, spark: SparkSession, config: Config | None = None) -> ClaimStore:
        """A store of its own in the folder that driver and executors share; drop() removes it."""
        return cls(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}", config)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)

    # Files

    def _read(self, path) -> dict:
        file = self._fs.open(path)
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _create(self, name: str, body: dict) -> None:
        """Fails if the file is there."""
        file = self._fs.create(self._path(f"{self.root}/_commits/{name}"), False)
        file.write(json.dumps(body).encode())
        file.close()

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_commits")))

    def snapshot(self) -> Snapshot:
        names = self._names()
        checkpoint = max((n for n in names if n.startswith("checkpoint-")), default=None)
        out = Snapshot()
        if checkpoint:
            body = self._read(self._path(f"{self.root}/_commits/{checkpoint}"))
            out = Snapshot(body["version"], body["folders"], body["keys"])
        for name in names:
            if name[:1].isdigit() and int(name.split(".")[0]) >= out.version:
                out.add(self._read(self._path(f"{self.root}/_commits/{name}")))
        return out

    def version(self) -> int:
        return max((int(n.split(".")[0]) + 1 for n in self._names() if n[:1].isdigit()), default=0)

    # Writing

    def commit(self, rows: dict[str, list[dict[str, Any]] | DataFrame], expected: int | None = None, key: tuple[str, int] | None = None, replaces: bool = False) -> int:
        """Appends rows to several tables as one unit; returns the commit's number.

        expected: the version that the writer has read. Ledger rows get their agent's next numbers. An edge that is there
        already, or comes twice, raises DuplicateEdge.
        """
        now = self.snapshot()
        if key is not None and now.knows(key):
            return now.version - 1
        if expected is not None and expected != now.version:
            raise CommitConflict(f"version {expected} was read, but {now.version} is there")
        name, written = uuid.uuid4().hex, {}
        for table, data in rows.items():
            df = data if isinstance(data, DataFrame) else self._frame(table, data) if data else None
            if df is None:
                continue
            if table == "ledger" and not replaces:
                df = self._numbered(df, now)
            path = f"{self.root}/data/{name}/{table}"
            df.select(*columns(table)).write.parquet(path)
            if table == "edges" and not replaces:
                self._refuse_twins(self.spark.read.schema(SCHEMAS[table]).parquet(path), now)
            written[table] = path
        body = {"number": now.version, "tables": written, "key": list(key) if key else None, "replaces": replaces}
        try:
            self._create(f"{now.version:012d}.json", body)
        except Exception as e:
            raise CommitConflict(f"commit {now.version} exists") from e
        if (now.version + 1) % CHECKPOINT_EVERY == 0:
            now.add(body)
            try:
                self._create(f"checkpoint-{now.version:012d}.json", {"version": now.version, "folders": now.folders, "keys": now.keys})
            except Exception:  # noqa: BLE001, S110  another writer has made the very same one
                pass
        return body["number"]

    def _frame(self, table: str, data: list[dict[str, Any]]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in columns(table)) for r in data], SCHEMAS[table])

    def _numbered(self, rows: DataFrame, now: Snapshot) -> DataFrame:
        """stream_seq: the agent's last number plus the row's place, in the order of its time and of stream_seq as given."""
        agents = rows.select("agent_id").distinct()
        last = self._table("ledger", now).join(agents, "agent_id", "left_semi").groupBy("agent_id").agg(F.max("stream_seq").alias("last_seq"))
        place = F.row_number().over(Window.partitionBy("agent_id").orderBy("recorded_at", F.col("stream_seq").asc_nulls_last(), "entry_id"))
        return rows.withColumn("place", place).join(last, "agent_id", "left").withColumn("stream_seq", (F.coalesce("last_seq", F.lit(0)) + F.col("place")).cast("long"))

    def _refuse_twins(self, edges: DataFrame, now: Snapshot) -> None:
        twice = edges.groupBy(*EDGE).count().where("count > 1").select(*EDGE)
        known = edges.join(self._table("edges", now), EDGE, "left_semi").select(*EDGE)
        found = twice.unionByName(known).limit(1).collect()
        if found:
            raise DuplicateEdge(f"{found[0].from_claim_id} {found[0].edge_kind} {found[0].to_claim_id} is there already")

    def retried(self, write: Callable[[Snapshot], T]) -> T:
        """Calls write with a fresh snapshot until no other commit comes in between."""
        for attempt in range(RETRIES):
            try:
                return write(self.snapshot())
            except CommitConflict:
                if attempt == RETRIES - 1:
                    raise
        raise AssertionError

    def compact(self) -> int:
        """Writes every table anew in few files."""
        return self.retried(lambda now: self.commit({n: self._table(n, now).coalesce(max(1, min(len(now.folders.get(n, [])), self.spark.sparkContext.defaultParallelism))) for n in SCHEMAS}, now.version, replaces=True))

    def vacuum(self) -> int:
        """Removes folders that the present version doesn't use; returns their number. Not while others read or write."""
        used = {path.rsplit("/", 2)[1] for paths in self.snapshot().folders.values() for path in paths}
        data = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    # Reading

    def _table(self, name: str, now: Snapshot) -> DataFrame:
        if not now.folders.get(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*now.folders[name])  # columns that old files lack are null

    def table(self, name: str, now: Snapshot | None = None) -> DataFrame:
        return checked(self._table(name, now or self.snapshot()), name)

    def tables(self, now: Snapshot | None = None) -> Tables:
        now = now or self.snapshot()
        return Tables(*(self.table(n, now) for n in ("claims", "assertions", "ledger", "edges", "pending")), self.config)


def columns(table: str) -> list[str]:
    return [c.strip().split()[0] for c in SCHEMAS[table].split(",")]


def checked(df: DataFrame, table: str) -> DataFrame:
    """df, which fails on reading a text that is no value of its enumeration; an unknown granularity is none."""
    of = lambda c, values: F.when(F.col(c).isNull() | F.col(c).isin(*values), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{table}.{c}: unknown value "), F.col(c))))
    out = df.withColumns({c: of(c, values).cast("string") for c, values in ENUMS[table].items()})
    return out.withColumns({c: known_granularity(F.col(c)) for c in out.columns if c in ("start_granularity", "end_granularity")})

