"""Daily use of the scorer and admission under the daily limit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from postaudit import schema as S
from postaudit.operators.pending import QUEUE_ORDER
from postaudit.operators.ranking import between, global_rank, moment, narrow


def quota_usage(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.to_date("scored_at").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


def used_on(scored: DataFrame, day: dt.date) -> int:
    """Calls made on `day`, 0 when there is none."""
    # A range of the column itself, so that it reaches the Parquet scan.
    at = F.col("scored_at")
    return scored.filter((at >= F.lit(day)) & (at < F.lit(day + dt.timedelta(days=1)))).count()


def admit(waiting: DataFrame, room: int) -> DataFrame:
    """Waiting posts with `admitted`: the first `room` in queue order are, the rest wait for the reset.

    Counts over the time column find where the last admitted post lies; only the posts of that moment are ranked,
    by their keys, all others follow from their time.
    """
    keys = waiting.select(*QUEUE_ORDER)
    if room <= 0:
        return keys.withColumn("admitted", F.lit(False))
    timed, untimed = keys.filter(F.col("created_at").isNotNull()), keys.filter(F.col("created_at").isNull())
    first = untimed.count()  # posts without a time come first in the queue
    if first >= room:
        placed = global_rank(untimed, [F.col(c) for c in QUEUE_ORDER], "_rank")
        early = placed.withColumn("admitted", F.col("_rank") <= F.lit(room)).drop("_rank")
        return early.unionByName(timed.withColumn("admitted", F.lit(False)))
    early = untimed.withColumn("admitted", F.lit(True))
    low, high, before = narrow(timed, "created_at", False, room - first, room - first)
    if low > high:  # there is room for all
        return early.unionByName(timed.withColumn("admitted", F.lit(True)))
    near = between(timed, "created_at", low, high)
    ranked = global_rank(timed.filter(near), [F.col(c) for c in QUEUE_ORDER], "_rank")
    edge = ranked.withColumn("admitted", F.col("_rank") <= F.lit(room - first - before)).drop("_rank")
    rest = timed.filter(~near).withColumn("admitted", F.col("created_at") < moment(timed, "created_at", low))
    return early.unionByName(rest).unionByName(edge)


def room_left(scored: DataFrame, day: dt.date, limit: int = S.DAILY_QUOTA) -> int:
    return max(limit - used_on(scored, day), 0)
