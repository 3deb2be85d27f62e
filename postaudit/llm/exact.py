"""Exact deduplication by an extendible-hash index; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.llm.common import HOT_PARTS, keep_rows, salted_lookup
from postaudit.session import materialise

CAPACITY = 50_000
"""Keys that a bucket of the index holds before it is split."""
SPARE_BITS = 5
"""Doublings that a directory allows beyond the depth at which buckets are full on average."""
DEEPEST = 20
"""Bits of a directory at most, so that it has a million cells or fewer and can be sent to all tasks."""


def _prefix(key, depth: int):
    """The key's first `depth` bits (at least one)."""
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) of every cell in use, and the cells' depth; `keys` has each key once.

    A cell is a key prefix at the directory's full depth. Where the bucket of a cell would hold more than
    `capacity` keys its depth grows by a bit, which doubles the directory there, until it fits. Buckets are
    numbered by their first cell, so their order is the keys' order. Beyond DEEPEST bits buckets hold more keys, and
    several owners share one.
    """
    start = max(1, math.ceil(math.log2(max(1, keys.count()) / capacity))) if capacity else 1
    start = min(start, DEEPEST)
    full = min(start + SPARE_BITS, DEEPEST)
    cells = keys.groupBy(_prefix(F.col("key"), full).alias("cell")).agg(F.count(F.lit(1)).alias("load"))
    depth = F.lit(full)
    for bits in range(full - 1, start - 1, -1):
        above = F.shiftrightunsigned(F.col("cell"), full - bits)
        cells = cells.withColumn("load_", F.sum("load").over(Window.partitionBy(above)))
        cells = cells.withColumn(f"fits_{bits}", F.col("load_") <= capacity)
    for bits in range(full - 1, start - 1, -1):
        depth = F.when(F.col(f"fits_{bits}"), F.lit(bits)).otherwise(depth)
    cells = cells.withColumn("depth", depth)
    free = F.lit(full) - F.col("depth")
    first = F.expr(f"shiftleft(shiftrightunsigned(cell, {full} - depth), {full} - depth)")
    return cells.select("cell", "depth", F.when(free == 0, F.col("cell")).otherwise(first).alias("bucket")), full


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _routed(rows: DataFrame, cells: DataFrame, full: int) -> DataFrame:
    """`rows` with the bucket and depth that the directory has for their key."""
    return rows.withColumn("cell", _prefix(F.col("key"), full)).join(F.broadcast(cells), "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index over the texts of `docs`: bucket, depth, key, chain, sha, keep_id, n; and its lookups: doc_id, bucket, key, sha.

    Both are files in the shared folder. The directory is split by the counts of the keys alone. Then each row goes to the owner of its
    bucket; an owner has a range of (bucket, key), compares the bytes of the texts that share a key and merges equal
    ones. The rows of a key with over 1/1000 of all rows go to several owners, whose entries are merged by SHA-256. Different
    texts of one key are numbered along its chain.
    """
    read = docs.select("doc_id", F.xxhash64(_text()).alias("key"), F.unhex(F.sha2(_text(), 256)).alias("sha"))
    read = materialise(read, folder)
    keys = materialise(read.groupBy("key").agg(F.count(F.lit(1)).alias("load")), folder)
    cells, full = directory(keys, capacity)
    cells = materialise(cells, folder)
    limit = max((keys.agg(F.sum("load")).first()[0] or 0) / HOT_PARTS, 1000)
    hot = keys.filter(F.col("load") > limit).select("key", F.ceil(F.col("load") / limit).alias("parts"))  # under 1,000
    rows = docs.select("doc_id", _text().alias("text")).withColumn("key", F.xxhash64("text"))
    rows = _routed(rows.join(F.broadcast(hot), "key", "left"), cells, full)
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))).drop("parts")
    owned = rows.repartitionByRange("bucket", "key", "part").groupBy("bucket", "depth", "key", "part", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    owned = materialise(owned.select("bucket", "depth", "key", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n"), folder)
    entries = owned.groupBy("bucket", "depth", "key", "sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    index = entries.select("bucket", "depth", "key", chain.alias("chain"), "sha", "keep_id", "n")
    return materialise(index, folder), _routed(read, cells, full).drop("depth")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their bytes are; a null text counts as an empty one. The row with the largest doc_id of
    a group stays (a null doc_id is smaller than any other). Rows that repeat both doc_id and text count each
    in group_size, and one of them stays. Texts of any length are compared whole. No rows in, no rows out. Other columns
    are not read. A row is looked up in its bucket by its key, and along the chain by its SHA-256.
    """
    index, rows = build_index(docs, capacity, folder)
    found = salted_lookup(rows, index, ["bucket", "key", "sha"], "n", F.col("doc_id"), "inner")
    again = F.row_number().over(Window.partitionBy("key", "sha", "doc_id").orderBy("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Rows that repeat id and text can't be told apart; their first number stays.
    return found.withColumn("again", again).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (stays & (F.col("again") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """`docs` without the rows that `exact_dedup` drops; all columns are passed on."""
    kept = exact_dedup(docs, capacity, folder).filter("kept").select("doc_id", F.col("text_sha256").alias("text_key"))
    return keep_rows(docs, kept, F.sha2(F.coalesce("text", F.lit("")), 256))
