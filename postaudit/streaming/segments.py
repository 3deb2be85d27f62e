"""Tables of micro-batches that are merged as they grow, so that a later batch reads a few segments and the last batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from postaudit.session import folder_exists

EVERY = 50
"""Batch numbers of a period; whole periods are merged into segments."""

Writer = Callable[[DataFrame, str], None]


def segments(batch_id: int, every: int = EVERY) -> list[tuple[int, int]]:
    """Ranges [low, high) of batch numbers that are merged before `batch_id`, the widest first.

    The whole periods are divided as by their number's binary digits, so there are at most log2 of them, and the
    ranges follow from the number alone.
    """
    periods, low, out = batch_id // every, 0, []
    for bit in reversed(range(periods.bit_length())):
        if periods >> bit & 1:
            out.append((low * every, (low + (1 << bit)) * every))
            low += 1 << bit
    return out


def _names(ddl: str, spark: SparkSession, *more: str) -> list[str]:
    return [*spark.createDataFrame([], ddl).columns, *more]


def _batches(spark: SparkSession, path: str, ddl: str, low: int, high: int) -> list[DataFrame]:
    """Rows of the batches low to high - 1 with their batch_id; only folders that exist are listed."""
    folders = [p for p in (f"{path}/batch_id={n}" for n in range(low, high)) if folder_exists(spark, p)]
    if not folders:
        return []
    return [spark.read.schema(f"{ddl}, batch_id INT").option("basePath", path).parquet(*folders)]


def _union(spark: SparkSession, parts: list[DataFrame], ddl: str) -> DataFrame:
    names = _names(ddl, spark, "batch_id")
    return reduce(DataFrame.unionByName, [p.select(*names) for p in parts] or [spark.createDataFrame([], f"{ddl}, batch_id INT")])


def _segment(spark: SparkSession, merged: str, ddl: str, low: int, high: int) -> DataFrame:
    return spark.read.schema(f"{ddl}, batch_id INT").parquet(f"{merged}/{low}-{high}")


def compact(spark: SparkSession, path: str, merged: str, ddl: str, batch_id: int, write: Writer, every: int = EVERY) -> None:
    """Make the segments below `batch_id` that are missing, a period from its batches and wider ones from two halves.

    So a row is written once for each doubling of the stream. Nothing is removed, so a batch that is run again finds
    what it found before. A mark written after a segment says that it is whole; one left unfinished is written again.
    """
    def make(low: int, high: int) -> None:
        mark = f"{merged}_marks/{low}-{high}"
        if folder_exists(spark, mark):
            return
        if high - low == every:
            parts = _batches(spark, path, ddl, low, high)
        else:
            middle = (low + high) // 2
            make(low, middle)
            make(middle, high)
            parts = [_segment(spark, merged, ddl, low, middle), _segment(spark, merged, ddl, middle, high)]
        write(_union(spark, parts, ddl), f"{merged}/{low}-{high}")
        spark.range(1).write.mode("overwrite").parquet(mark)

    for low, high in segments(batch_id, every):
        make(low, high)


def read_merged(spark: SparkSession, path: str, merged: str, ddl: str, batch_id: int, every: int = EVERY) -> DataFrame:
    """Rows of all batches below `batch_id`, with batch_id: from the segments, then from the batches after them.

    A column of `ddl` may be one that both are divided by in folders; a filter on it then prunes them.
    """
    made = segments(batch_id, every)
    while made and not all(folder_exists(spark, f"{merged}_marks/{a}-{b}") for a, b in made):
        made.pop()
    parts = [_segment(spark, merged, ddl, a, b) for a, b in made]
    return _union(spark, parts + _batches(spark, path, ddl, made[-1][1] if made else 0, batch_id), ddl)


def read_places(spark: SparkSession, path: str, ddl: str, places: DataFrame, partition: str) -> DataFrame:
    """Rows of the folders that `places` (batch_id and the INT column `partition`) names, each of which exists."""
    folders = [f"{path}/batch_id={b}/{partition}={p}" for b, p in places.select("batch_id", partition).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], ddl)
    made = spark.read.schema(f"{ddl}, batch_id INT, {partition} INT").option("basePath", path).parquet(*folders)
    return made.select(*_names(ddl, spark))
