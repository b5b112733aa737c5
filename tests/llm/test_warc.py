import struct
import zipfile

import pytest

from credence.llm import warc
from credence.llm._common import fresh_path
from tests.llm.oracle import SF, assert_same


def test_whole_table(spark):
    assert assert_same(warc.round_trip(spark, SF), warc.ROUND_TRIP_SQL) == 250


def test_edges(spark):
    rows = [(1, "http://a/\r\nx", "same", 0), (2, None, "same", 0), (2, None, "same", 0), (3, "u", None, 0), (None, "u", "", 0), (None, "v", "lone", 0), (None, "v", "lone", 0), (4, "v", "é" * 200_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    got = sorted(warc.read_archives(warc.write_archives(pages, fresh_path(spark, "archives"))).collect(), key=str)
    assert len(got) == len(rows)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == sorted([("1", "revisit", 2, 4), ("2", "response", None, 4), ("2", "response", None, 4), ("3", "response", None, 0), ("None", "revisit", 3, 0), ("None", "response", None, 4), ("None", "response", None, 4), ("4", "response", None, 400_000)])
    assert {r.url for r in got if r.page_id == 1} == {"http://a/  x"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "archives"))).count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def read(self, at, n):
        return self.raw[at : at + n]


def test_directories_as_another_writer_makes_them(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.txt", "plain")
        z.writestr("b/c.txt", "inside " * 1000)
        z.writestr("packed", "x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 in a comment of some length"
    source = Bytes(path.read_bytes())
    members = warc.directory(source)
    start = warc.data_start(source, members["b/c.txt"])
    assert source.read(start, members["b/c.txt"].size) == b"inside " * 1000
    with pytest.raises(ValueError):
        warc.data_start(source, members["packed"])
    with pytest.raises(ValueError):
        warc.directory(Bytes(b"nothing here" * 9))


def test_zip64_records():
    name, body = b"big", b"12345"
    local = warc.LOCAL + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, warc.MAX32, warc.MAX32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = warc.CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, warc.MAX32, warc.MAX32, len(name), len(extra), 0, 0, 0, 0, warc.MAX32) + name + extra
    end64 = warc.END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = warc.END + struct.pack("<4H2IH", 0, 0, warc.MAX16, warc.MAX16, warc.MAX32, warc.MAX32, 0)
    source = Bytes(local + central + end64 + locator + end)
    member = warc.directory(source)["big"]
    assert source.read(warc.data_start(source, member), member.size) == body
