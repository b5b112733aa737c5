"""WARC archives packed in ZIP files, written and read back without extraction.

write_archives() packs each partition's records (one gzip member each) in a stored ZIP member `archive/data.warc.gz`, with
their offsets in `indexes/index.cdxj`. read_archives() parses the end record, the ZIP64 records and the central directory,
locates the stored members by their local headers, and range-reads index and records; nothing is unpacked to a disk.

Of rows with equal payloads, the one with the largest page_id is a response and the others revisit it.

Defined cases: null html is an empty payload; null page_id counts as smaller than all others, and rows of a payload that
has no page_id at all are all responses; rows that repeat the largest page_id of a payload are all responses; null urls
give records without a target; line ends in urls become spaces; further columns are ignored; an empty table gives archives
without records or none.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm._common import fresh_path, read_table, slices, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 4 << 20
NAMESPACE = uuid.UUID("6f2f5bd1-6c6f-5d4e-9f5e-2f4f1d0f2b11")

# Signatures and fixed parts of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int  # offset of the local header


class RangeFile:
    """Reads ranges of one file in any store that pyarrow reaches."""

    def __init__(self, uri: str):
        where, path = pafs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def directory(source: RangeFile) -> dict[str, Member]:
    """The members that the central directory names; ZIP64 records hold where the classic fields are full."""
    start = max(0, source.size - 22 - MAX16)
    tail = source.read(start, source.size - start)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack("<10xHII", tail[at : at + 20])
    where = start + at - 20
    if where >= 0 and source.read(where, 4) == LOCATOR64:
        (end64,) = struct.unpack("<8xQ4x", source.read(where, 20))
        record = source.read(end64, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        count, size, offset = struct.unpack("<32xQQQ", record)
    raw, members, p = source.read(offset, size), {}, 0
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, _, packed, plain, names, extras, notes, header = struct.unpack("<10xH4xIIIHHH8xI", raw[p : p + 46])
        name = raw[p + 46 : p + 46 + names].decode("utf-8")
        extra, e = raw[p + 46 + names : p + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # ZIP64: only the full fields are there, in this order
                wide = list(struct.unpack(f"<{length // 8}Q", extra[e + 4 : e + 4 + length // 8 * 8]))
                plain = wide.pop(0) if plain == MAX32 else plain
                packed = wide.pop(0) if packed == MAX32 else packed
                header = wide.pop(0) if header == MAX32 else header
            e += 4 + length
        members[name] = Member(name, method, packed, plain, header)
        p += 46 + names + extras + notes
    return members


def data_start(source: RangeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = source.read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    names, extras = struct.unpack("<26xHH", head)
    return member.header + 30 + names + extras


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    out = io.BytesIO()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"))
    out.write(packer.flush())
    return out.getvalue()


def parse_record(packed: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return {"fields": fields, "payload": block.partition(b"\r\n\r\n")[2]}


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html and, for revisits, refers_to: the largest page_id with the same payload (by SHA-256, SHA-1 and length)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    key = F.concat(F.sha2(body, 256), F.sha1(body), F.octet_length(body).cast("string"))
    groups = rows.groupBy(key.alias("key")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last")
    groups = staged(groups, "warc-groups")  # its size is known from here on: small ones are broadcast, others joined
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.withColumn("key", key).join(groups, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives to a folder that executors share; returns path and records of each, from finished tasks only."""
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri, store, n = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.wacz", None, 0
        index: list[str] = []
        for part in slices(batches, "html"):
            if store is None:
                place, file = pafs.FileSystem.from_uri(uri)
                sink = place.open_output_stream(file)
                store = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                member, at = store.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0
            for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                raw = record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None)
                member.write(raw)
                index.append(json.dumps({"page": page_id, "offset": at, "length": len(raw)}))
                at, n = at + len(raw), n + 1
        if store is not None:
            member.close()
            store.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            store.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
            store.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return staged(classified(pages).mapInArrow(run, "path string, n_records long"), "warc-manifest")


def records_of(uri: str) -> Iterator[dict]:
    """The records of one archive in the order of its index, read by ranges of about READ_BYTES."""
    source = RangeFile(uri)
    try:
        members = directory(source)
        data, index = data_start(source, members[DATA]), data_start(source, members[INDEX])
        entries = source.read(index, members[INDEX].size).decode().splitlines()
        held, start = b"", 0
        for entry in map(json.loads, entries):
            at, n = entry["offset"], entry["length"]
            if not (start <= at and at + n <= start + len(held)):
                held, start = source.read(data + at, max(n, min(READ_BYTES, members[DATA].size - at))), at
            yield parse_record(held[at - start : at - start + n])
    finally:
        source.close()


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives at `path`; the payload of every response is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for record in records_of(uri):
                    f = record["fields"]
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    sha = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and digest(record["payload"]) != sha:
                        raise ValueError(f"{uri}: payload and digest of {f['WARC-Record-ID']} differ")
                    rows.append((number("X-Page-Id"), number("X-Payload-Length"), sha, f["WARC-Type"], number("X-Refers-To-Page"), f.get("WARC-Target-URI")))
                    if len(rows) == 5000:
                        yield _record_batch(rows)
                        rows = []
                if rows:
                    yield _record_batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages and reads them back."""
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), fresh_path(spark, "archives"))).drop("url")


ROUND_TRIP_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN g.last IS NULL OR p.page_id = g.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.last IS NULL OR p.page_id = g.last THEN NULL ELSE g.last END AS refers_to
FROM p JOIN g USING (html)
"""
