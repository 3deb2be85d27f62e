"""Joining rows by key: plain joins that Spark plans by size, and a split for the jobs that are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_PARTS = 1000
"""A job with more than one in so many posts is hot, so there are fewer hot jobs than this."""
HOT_POSTS = 100_000
"""No job below this many posts is split."""


def salt(*keys: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def join_by_job(posts: DataFrame, jobs: DataFrame, how: str = "inner", hot_posts: int = HOT_POSTS) -> DataFrame:
    """Posts with the columns of their job (one row per job_id in `jobs`).

    A count over the key column finds the hot jobs. Where there is none this is a plain join, which Spark
    broadcasts or shuffles by the jobs' size. Else the posts of hot jobs are dealt to parts within 1/1000 of
    all posts each, and only the rows of those jobs (under 1,000, by their definition) are copied per part.
    """
    counts = posts.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("largest")).first()
    limit = max((most["all"] or 0) // HOT_PARTS, hot_posts)
    if (most["largest"] or 0) <= limit:
        return posts.join(jobs, "job_id", how)
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select(
        "job_id", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    dealt = F.coalesce(F.pmod(F.xxhash64("tweet_id"), F.col("_parts")), F.lit(0)).cast("int")
    spread = posts.join(hot, "job_id", "left").withColumn("_salt", dealt).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copies = jobs.join(hot, "job_id", "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return spread.join(copies, ["job_id", "_salt"], how).drop("_salt")


def match_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Rows whose key is in `keys` (left_semi) or is not (left_anti); few keys are broadcast by Spark."""
    return rows.join(keys.select(*on), list(on), how)
