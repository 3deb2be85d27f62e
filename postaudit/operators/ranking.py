"""Row numbers, top rows and places in a whole table without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postaudit.operators.joins import salt
from postaudit.session import materialise

_ROW_BITS = (1 << 33) - 1
SALTS = 128
SLICES = 1000
CLOSE_ROWS = 50_000
"""A range of times with this many rows is narrow enough to be sorted."""


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of each row in the total order `order`.

    Rows are range-partitioned and sorted in parallel, and written once so both readings see the
    same placing. A position is the row's place in its partition plus the sizes of the partitions
    before; only those sizes, one row per partition, meet in one task.
    """
    # 33 low bits of the increasing id count the rows of a partition.
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))))
    sizes = placed.groupBy("_part").count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_row") + 1)
            .drop("_part", "_row", "_start"))


def moment(df: DataFrame, column: str, micros: int) -> Column:
    """A constant of the column's own type, so that a comparison with it reaches the scan."""
    return F.timestamp_micros(F.lit(micros).cast("bigint")).cast(df.schema[column].dataType)


def between(df: DataFrame, column: str, low: int, high: int) -> Column:
    return (F.col(column) >= moment(df, column, low)) & (F.col(column) <= moment(df, column, high))


def narrow(df: DataFrame, column: str, descending: bool, first: int, last: int, close: int = CLOSE_ROWS) -> tuple[int, int, int]:
    """(low, high, before): a range of the time `column`, in microseconds, that holds the rows `first` to `last` (from 1)
    of its order, and the number of rows before it. Rows without a time are left out. Nothing in range: low is above high.

    A round is one sketch of the range's quantiles, which proposes a narrower range, and one exact count of what
    lies in it and before it, which corrects it. Ranges are conditions on the column itself. It ends with few
    rows to sort, or with one moment.
    """
    at = F.unix_micros(F.col(column).cast("timestamp"))
    fractions = F.array(*[F.lit(i / SLICES) for i in range(SLICES + 1)])
    low, high, before = None, None, 0
    while True:
        inside = df.filter(F.col(column).isNotNull()) if low is None else df.filter(between(df, column, low, high))
        found = inside.select(at.alias("k")).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("k", fractions, F.lit(10 * SLICES)).alias("q")).first()
        n, cuts = found["n"], found["q"]
        if before + n < first:
            return 1, 0, before + n
        ends = cuts[0], cuts[-1]
        place = lambda rank: (rank - before) * SLICES / n
        near = max(0, int(place(first)) - 2), min(SLICES, int(place(min(last, before + n))) + 3)
        if descending:
            near = SLICES - near[1], SLICES - near[0]
        tried = cuts[near[0]], cuts[near[1]]
        if tried != ends:
            ahead = F.count_if(F.col("k") > tried[1]) if descending else F.count_if(F.col("k") < tried[0])
            reach = between(df, column, tried[0], ends[1]) if descending else between(df, column, ends[0], tried[1])
            exact = inside.filter(reach).select(at.alias("k")).agg(ahead.alias("ahead"), F.count(F.lit(1)).alias("seen")).first()
            if before + exact["ahead"] < first and (before + exact["seen"] >= last or exact["seen"] == n):
                before, n = before + exact["ahead"], exact["seen"] - exact["ahead"]
                ends = tried
        if n <= close or ends[0] == ends[1] or (low, high) == ends:
            return ends[0], ends[1], before
        low, high = ends


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int, spread_by: str,
                salts: int = SALTS) -> DataFrame:
    """The first `n` rows of every key; a key's rows are first narrowed in `salts` separate tasks."""
    part = W.partitionBy(key, "_salt").orderBy(*order)
    whole = W.partitionBy(key).orderBy(*order)
    narrowed = (df.withColumn("_salt", salt(spread_by, salts=salts))
                .withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n))
    return (narrowed.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= n)
            .drop("_n", "_salt"))
