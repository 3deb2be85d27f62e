"""Packages: exact round trip, directories of both kinds, ranges, revisits."""

import base64
import hashlib
import io
import random
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postaudit.llm import warc

PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""),
         (6, "é", "ünï\r\n\r\n" * 50), (7, "long", "y" * 300_000), (None, "none", "other"), (8, "a", "only"), (8, "a", "only")]
PAGES += [(100 + i, f"http://h/{i}", "hot") for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(p, u, h, 3, "x") for p, u, h in rows], "page_id long, url string, html string, n int, digest string")


def expected(rows, least):
    first = {}
    for p, _, h in rows:
        h = h or ""
        first[h] = max((x for x in (first.get(h), p) if x is not None), default=None)
    out = []
    for p, u, h in rows:
        raw = (h or "").encode()
        again = p != first[h or ""] and len(raw) >= least
        out.append((p, u and u.replace("\r", "%0D").replace("\n", "%0A"), len(raw),
                    base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                    first[h or ""] if again else None, None if again else raw))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,records", [(0, 20_000), (4, 7)])
def test_round_trip(spark, tmp_path, monkeypatch, least, records):
    monkeypatch.setattr(warc, "RUN_BYTES", 700)
    packages = warc.write_archives(frame(spark, PAGES), f"file://{tmp_path}", least)
    assert packages.agg(F.sum("records")).first()[0] == len(PAGES)
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(packages).collect()]
    assert sorted(got, key=repr) == expected(PAGES, least)
    one = zipfile.ZipFile(packages.first().path.removeprefix("file://"))
    assert one.testzip() is None and {i.compress_type for i in one.infolist()} == {zipfile.ZIP_STORED}


def test_empty(spark, tmp_path):
    assert warc.read_archives(warc.write_archives(frame(spark, []), str(tmp_path))).collect() == []


def test_directories():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"first")
        z.writestr("dir/b", b"second", compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a note PK"
    raw = plain.getvalue()
    found = warc.members(plain, len(raw))
    method, at, n = found["a"]
    assert method == 0 and raw[at:at + n] == b"first" and found["dir/b"][0] == zipfile.ZIP_DEFLATED
    with pytest.raises(ValueError, match="compressed"):
        warc.stored(plain, len(raw), "dir/b")
    with pytest.raises(ValueError, match="no end"):
        warc.members(io.BytesIO(b"x" * 100), 100)


def test_zip64_directory():
    """A package as large ones have it: all sizes and offsets in the 64-bit fields."""
    name, data = b"archive/data.warc.gz", b"stored bytes"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 5)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name),
                                        len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    start = 5 + len(local) + len(data)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 2**32 - 1, 2**32 - 1, 0)
    raw = b"junk!" + local + data + entry + end64 + locator + end
    at, n = warc.stored(io.BytesIO(raw), len(raw), name.decode())
    assert raw[at:at + n] == data


def test_a_broken_payload_is_an_error():
    raw = warc.make_record(1, "u", b"abc", 3, warc.digest32(b"abc"), None, None)
    assert warc.read_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(raw.replace(b"abc", b"abd"))


def test_ranges_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """One package's ranges, rows of a few bytes, are not left to one task by adaptive execution."""
    monkeypatch.setattr(warc, "RUN_BYTES", 4000)
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    rng = random.Random(4)
    rows = [(i, "u", "".join(rng.choices("abcdefghij", k=1000))) for i in range(200)]
    packages = warc.write_archives(frame(spark, rows).coalesce(1), f"file://{tmp_path}")
    found = warc.read_archives(packages).select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in found) == list(range(200))
    per_task = Counter(r.task for r in found)
    assert len(per_task) >= 12 and max(per_task.values()) <= 60
