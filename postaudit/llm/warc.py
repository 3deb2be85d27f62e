"""WARC records in ZIP packages: written with an index, read back by ranges through the package's directories."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.llm.common import salted_lookup
from postaudit.session import interim_dir, materialise

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_RECORDS = 20_000
"""Records of a package, which bounds the index that a task holds."""
RUN_BYTES = 4 << 20
"""Neighbouring records are read in one range of this size; a larger record is a range of its own."""
TASK_BYTES = 32 << 20
"""Packed bytes of ranges that a reading task is given, about."""
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_path(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """A file system for any URI that pyarrow knows (file, hdfs, s3, gs, or a plain path), and the path in it."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


# ---------------------------------------------------------------- records


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str) -> str:
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def make_record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to, refers_url) -> bytes:
    """A response, or a revisit of `refers_to` where `payload` is None. Line ends in URLs become %0D and %0A."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if payload is None else "response")
    head += _line("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>") + _line("WARC-Date", DATE)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha1:{digest}")
    if payload is None:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:x-page:{refers_to}>")
        if refers_url is not None:
            head += _line("WARC-Refers-To-Target-URI", refers_url)
    head += _line("Content-Type", "application/http;msgtype=response") + _line("Content-Length", str(len(block)))
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """The fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    number = lambda name: fields.get(name, "<urn:x-page:>")[len("<urn:x-page:"):-1] or None
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_digest": digest, "payload_bytes": size, "refers_to": number("warc-refers-to"),
            "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- packages


def write_package(path: str, records: Iterator[tuple[bytes, dict]]) -> int:
    """Write (record, index fields) to a ZIP with two stored members; each record is a gzip member of its own."""
    system, at = open_path(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    entries, offset = [], 0
    with system.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as member:
            for raw, fields in records:
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(raw) + packer.flush()
                member.write(data)
                entries.append({**fields, "offset": offset, "length": len(data)})
                offset += len(data)
        package.writestr(INDEX, "".join(json.dumps(e) + "\n" for e in entries))
    return len(entries)


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and offsets of a directory entry, those that don't fit taken from its ZIP64 field in order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4:at + 4 + size]
        at += 4 + size
    out, place = [], 0
    for value in values:
        if value == 0xFFFFFFFF:
            value, place = struct.unpack_from("<Q", wide, place)[0], place + 8
        out.append(value)
    return out


def members(file: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of the data, length) from the central directory; only headers are read."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) != n:
            raise ValueError("the package ends early")
        return data

    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail[end - 20:end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        count, length, start = struct.unpack_from("<QQQ", read(struct.unpack_from("<Q", locator, 8)[0], 56), 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        local, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + names].decode("utf-8")
        extra = directory[at + 46 + names:at + 46 + names + extras]
        _, packed, local = _wide(extra, full, packed, local)
        header = read(local, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"broken local header of {name}")
        found[name] = method, local + 30 + sum(struct.unpack_from("<HH", header, 26)), packed
        at += 46 + names + extras + notes
    return found


def stored(file: BinaryIO, size: int, name: str) -> tuple[int, int]:
    method, start, length = members(file, size)[name]
    if method:
        raise ValueError(f"{name} is compressed, so its records have no ranges")
    return start, length


# ---------------------------------------------------------------- Spark


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, interim: str | None = None) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) to packages in `folder`; returns path, records.

    A null html is an empty payload. Of equal payloads of `min_bytes` or more (equal SHA-1 and length) the row with the
    largest page_id is the response and others revisit it; rows that repeat page_id and payload are all
    responses. A null page_id is smaller than any other. Tasks choose new file names, and only packages in the
    returned table count, so a repeated task leaves a stray file at most. No rows in, no packages out.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", html.alias("payload")).withColumns({
        "digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    first = F.max(F.struct("page_id", "url")).alias("first")
    groups = materialise(keyed.groupBy("digest", "size").agg(first, F.count(F.lit(1)).alias("n")), interim)
    rows = salted_lookup(keyed, groups, ["digest", "size"], "n", F.col("page_id"), "inner")
    again = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("size") >= min_bytes)
    rows = rows.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size",
                       F.when(again, F.col("first.page_id")).alias("refers_to"),
                       F.when(again, F.col("first.url")).alias("refers_url"), again.alias("again"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, dict]]:
        for batch in batches:
            batch = batch.astype({"page_id": object, "refers_to": object})
            for r in batch.itertuples(index=False):
                page, other = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                payload = None if r.again else r.payload
                raw = make_record(page, r.url, payload, int(r.size), base64.b32encode(r.digest).decode(), other, r.refers_url)
                yield raw, {"page_id": page}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = records(batches)
        while (one := next(rest, None)) is not None:
            def part(first=one):
                yield first
                for _ in range(PACKAGE_RECORDS - 1):
                    if (more := next(rest, None)) is None:
                        return
                    yield more
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            yield pd.DataFrame({"path": [path], "records": [write_package(path, part())]})

    whole = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(whole.mapInPandas(run, "path string, records long"), interim)


def runs(packages: DataFrame) -> DataFrame:
    """path, start and lengths of neighbouring records, from the packages' indexes alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, at = open_path(path)
                size, out = system.get_file_info(at).size, []
                with system.open_input_file(at) as file:
                    base, _ = stored(file, size, ARCHIVE)
                    start, length = stored(file, size, INDEX)
                    file.seek(start)
                    entries = [json.loads(x) for x in file.read(length).decode().splitlines()]
                for e in entries:
                    at_end = out and base + e["offset"] == out[-1][1] + out[-1][3]
                    if not at_end or out[-1][3] + e["length"] > RUN_BYTES:
                        out.append([path, base + e["offset"], [], 0])
                    out[-1][2].append(e["length"])
                    out[-1][3] += e["length"]
                yield pd.DataFrame([x[:3] for x in out], columns=["path", "start", "lengths"])

    return packages.select("path").mapInPandas(run, "path string, start long, lengths array<long>")


def read_ranges(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of `ranges` (as from `runs`): page_id, url, record_type, payload_digest, payload_bytes, refers_to
    and, unless left out, payload (null for revisits). A record that fails its digest is an error."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * payloads]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, lengths in batch.itertuples(index=False):
                system, at = open_path(path)
                with system.open_input_file(at) as file:
                    file.seek(start)
                    data = file.read(int(sum(lengths)))
                found, place = [], 0
                for n in lengths:
                    found.append(read_record(zlib.decompress(data[place:place + n], 31)))
                    place += n
                yield pd.DataFrame(found, columns=names).astype({"page_id": object, "refers_to": object})

    schema = ("page_id string, url string, record_type string, payload_digest string, payload_bytes long, "
              "refers_to string" + ", payload binary" * payloads)
    made = ranges.mapInPandas(run, schema)
    return made.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def read_archives(packages: DataFrame, payloads: bool = True, interim: str | None = None) -> DataFrame:
    """All records of `packages` (path): indexes first, then their ranges dealt anew to all tasks.

    Ranges are rows of a few bytes that stand for megabytes, so the number of tasks comes from the bytes they
    stand for, and a given number isn't joined to fewer by adaptive execution. No packages, no records; columns other than path are not read.
    """
    ranges = materialise(runs(packages), interim)
    size = ranges.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)"))).first()[0] or 0
    tasks = max(math.ceil(size / TASK_BYTES), ranges.sparkSession.sparkContext.defaultParallelism)
    return read_ranges(ranges.repartition(tasks, "path", "start"), payloads)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write `pages` to packages in the shared folder and read all records back, without their payloads."""
    at = f"{interim_dir(pages.sparkSession, folder)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, at, min_bytes, folder), False, folder)
