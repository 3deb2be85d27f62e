"""Archives of posts: scan, format, members, JSON arrays, and the split into good and bad."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postaudit import schema as S
from postaudit.functions.posts import post_columns
from postaudit.functions.text import bind, bind_body
from postaudit.operators.joins import match_keys
from postaudit.session import materialise
from postaudit.sources.chunks import CHUNK_CHARS, read_archive, read_path

_PIECE_DDL = "path STRING, member STRING, first_pos BIGINT, js STRING, cut BOOLEAN, error STRING"

_PIECE_TYPE = pa.schema([("path", pa.string()), ("member", pa.string()), ("first_pos", pa.int64()), ("js", pa.string()),
                         ("cut", pa.bool_()), ("error", pa.string())])

BATCH_BYTES = 4 << 20
"""What a Python step holds of its results before it hands them on,"""
BATCH_ROWS = 1000
"""and how many rows at most."""

WHOLE_BYTES = 256 << 20
"""A longer file is not carried in a row."""


@dataclass(frozen=True)
class Ingested:
    posts: DataFrame
    bad_archives: DataFrame
    bad_rows: DataFrame


def whole_bytes(spark: SparkSession) -> int:
    """Length up to which a file's bytes come with its row; longer ones are opened by the task that reads them."""
    return min(WHOLE_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))


def with_long_files(listed: DataFrame) -> DataFrame:
    """Rows of the binaryFile source, where `content` is NULL for files above whole_bytes: their bytes are not read.

    The condition on `length` is pushed into the source, which knows it before it opens a file.
    """
    limit = whole_bytes(listed.sparkSession)
    kind = listed.schema["content"].dataType
    long = listed.filter(F.col("length") > limit).select(
        *[c for c in listed.columns if c != "content"], F.lit(None).cast(kind).alias("content"))
    return listed.filter(F.col("length") <= limit).unionByName(long)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows path, modificationTime, length, content; see with_long_files."""
    return with_long_files(spark.read.format("binaryFile").load(path))


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.unhex(F.lit(S.ZIP_MAGIC_HEX))


def js_text(content: Column) -> Column:
    """The text of a plain JS file, invalid UTF-8 replaced."""
    return F.make_valid_utf8(F.decode(content, "UTF-8"))


def in_small_batches(rows: Iterator[tuple[dict, int]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches of about BATCH_BYTES, so that a task's Python never holds what it makes of a whole input batch."""
    held, size = [], 0
    for row, length in rows:
        held.append(row)
        size += length
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def one_by_one(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches; only the current row's values are Python objects."""
    for batch in batches:
        for values in zip(*[batch.column(c) for c in columns]):
            yield tuple(v.as_py() for v in values)
        batch = values = None  # before the next one is read
        pa.default_memory_pool().release_unused()


def read_pieces(files: DataFrame, all_parts: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The one Python step of the ingest: each file becomes rows path, member, first_pos, js, cut, error.

    A row without `content` names a long file, which is opened and read in blocks. Several such rows are dealt to
    as many tasks as there are, as listing them costs next to nothing. Spark sends up to 64 MB of files at once
    (spark.sql.execution.arrow.maxBytesPerBatch); they are opened one by one, and the pieces go out in small batches.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for path, content in one_by_one(batches, "path", "content"):
            read = (read_path(path, all_parts, chunk_chars) if content is None
                    else read_archive(content, all_parts, chunk_chars))
            for piece in read:
                yield {"path": path, **piece}, len(piece["js"] or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_small_batches(pieces(batches), _PIECE_TYPE)

    return files.select("path", "content").mapInArrow(run, _PIECE_DDL)


def parse_array(body: Column) -> Column:
    """The raw posts of a JSON array; NULL when it is malformed, cut short or has text behind it."""
    return F.from_json(F.concat(F.lit('{"a":'), body, F.lit("}")), f"a ARRAY<STRUCT<{S.RAW_POST_DDL}>>")["a"]


def parse_js_files(files: DataFrame) -> DataFrame:
    """Raw posts of files known to be plain JS of ordinary length, without a Python step: path, pos, tweet.

    A file that cannot be read gives no row; parse_pieces also tells why.
    """
    return bind_body(files, js_text(F.col("content"))).select(
        "path", F.posexplode(parse_array(F.col("_body")))).select("path", "pos", F.col("col.tweet").alias("tweet"))


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """Raw posts of all pieces: path, member, pos, tweet, error; a broken piece is one row with error."""
    # Unwrapping a piece that is an array already gives the piece.
    parsed = bind(bind_body(pieces, F.col("js")), "_raw", F.when(F.col("_body") != "", parse_array(F.col("_body"))))
    error = F.coalesce("error", F.when(F.col("_body") == "", S.ERROR_UNWRAP)
                       .when(F.col("_raw").isNull(), S.ERROR_JSON))
    rows = parsed.select("path", "member", "first_pos", error.alias("error"), F.posexplode_outer("_raw"))
    return rows.filter(F.col("error").isNotNull() | F.col("pos").isNotNull()).select(
        "path", "member", (F.col("first_pos") + F.col("pos")).alias("pos"),
        F.col("col.tweet").alias("tweet"), "error")


def bad_archives(raw: DataFrame) -> DataFrame:
    """One row per archive that has any broken piece."""
    return (raw.filter(F.col("error").isNotNull()).groupBy("path")
            .agg(F.concat(F.lit(S.ERROR_PREFIX), F.min("error")).alias("error")))


def good_rows(raw: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of archives without a broken piece; one error fails its archive as a whole."""
    return match_keys(raw.filter(F.col("error").isNull()), bad, ["path"], "left_anti").drop("error")


def normalise(raw: DataFrame, run_ts: Column, job_id: Column) -> DataFrame:
    """Posts of readable elements, see has_post; path, member and pos tell where each stands."""
    place = [c for c in ("path", "member") if c in raw.columns]
    return raw.filter(has_post()).select(job_id.alias("job_id"), *place, "pos", *post_columns(F.col("tweet"), run_ts))


def has_post() -> Column:
    """Whether an element holds a post; one without an id could not be told from another."""
    return F.col("tweet").isNotNull() & (F.coalesce("tweet.id_str", F.lit("")) != "")


def job_of_path() -> Column:
    """The whole path: files of one name in two folders, or of two formats, are different jobs."""
    return F.regexp_replace("path", "^file:/+", "/")


def ingest(files: DataFrame, run_ts: dt.datetime, job_id: Column | None = None, all_parts: bool = False,
           max_bytes: int | None = None, chunk_chars: int = CHUNK_CHARS) -> Ingested:
    """Posts, unreadable archives and unreadable elements of a set of files.

    Files of any size are read; with `max_bytes`, larger ones are refused by their listed length. Parsed rows
    are written once, so that finding the bad archives does not unzip everything again. Elements
    without a post or an id are bad rows.
    """
    job_id = job_of_path() if job_id is None else job_id
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    fitting = files.filter(small)
    refused = files.filter(~small).select(
        "path", F.lit(f"{S.ERROR_PREFIX}file size exceeds maximum allowed size of {max_bytes} bytes").alias("error"))
    raw = materialise(parse_pieces(read_pieces(fitting, all_parts, chunk_chars)))
    bad = bad_archives(raw)
    good = good_rows(raw, bad)
    failed = bad.unionByName(refused).withColumn("job_id", job_id)
    return Ingested(
        posts=normalise(good, F.lit(run_ts), job_id),
        bad_archives=failed.select("job_id", "path", "error"),
        bad_rows=good.filter(~has_post()).select(job_id.alias("job_id"), "path", "member", "pos"))
