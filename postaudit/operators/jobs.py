"""Job rows: counters and status computed from the data, and the upsert of job updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postaudit import schema as S
from postaudit.functions.text import is_repost

FLUSH_WINDOW = "5 seconds"
_FROM_FIRST = {"file_id", "created_at"}


def parse_summary(posts: DataFrame) -> DataFrame:
    repost = is_repost(F.col("text"))
    return posts.groupBy("job_id").agg(
        F.count_if(~repost).alias("originals"), F.count_if(repost).alias("retweets"))


def job_progress(state: DataFrame) -> DataFrame:
    """Counters per job from the post state: columns needs_scoring, processed, should_flag.

    Every post counts once, whatever happens to it. `should_flag` is the outcome of the filter
    or, for a scored post, of the scorer.
    """
    called = F.col("needs_scoring") & F.col("processed")
    return state.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("processed")).alias("processed"),
        F.count_if(called).alias("calls"),
        F.count_if(F.col("processed") & F.col("should_flag")).alias("flagged"))


def count_changes(posts: DataFrame, flagged: DataFrame, scored: DataFrame) -> DataFrame:
    """What these rows add to the counters of their jobs: job_id and schema.COUNTS, one row per job.

    Changes of several runs or batches add up, so counters are kept by adding and no post is counted twice.
    """
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    when = lambda test: F.when(test, one).otherwise(none)

    def part(rows: DataFrame, **columns) -> DataFrame:
        return rows.select("job_id", *[columns.get(c, none).alias(c) for c in S.COUNTS])

    rows = part(posts, posts=one).unionByName(
        part(flagged, flagged=one, filtered=when(F.col("filter_reason") != S.SCORER_REASON))).unionByName(
        part(scored, scored=one, calls=when(F.col("score_status") == "scored")))
    return add_counts(rows)


def add_counts(changes: DataFrame) -> DataFrame:
    """One row per job, the sum of its changes."""
    return changes.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in S.COUNTS])


def progress_from_counts(changes: DataFrame) -> DataFrame:
    """Counters per job from any number of changes; a job without posts has none."""
    return add_counts(changes).filter("posts > 0").select(
        "job_id", F.col("posts").alias("total"), (F.col("filtered") + F.col("scored")).alias("processed"), "calls", "flagged")


def progress_from_tables(posts: DataFrame, flagged: DataFrame, scored: DataFrame) -> DataFrame:
    """The same counters from the stored tables: one grouping of job ids, no post is joined to another."""
    return progress_from_counts(count_changes(posts, flagged, scored))


def job_status(jobs: DataFrame, progress: DataFrame, failed: DataFrame, waiting: DataFrame) -> DataFrame:
    """One status per job.

    `failed` holds the job_id and error of archives that could not be read, `waiting` the pending
    posts with `admitted`. All sides are reduced to one row per job before they meet.
    """
    blocked = waiting.groupBy("job_id").agg(F.bool_or(~F.col("admitted")).alias("_blocked"))
    broken = failed.groupBy("job_id").agg(F.min("error").alias("error"))
    counts = progress.select("job_id", "total", "processed")
    joined = (jobs.select("job_id").join(counts, "job_id", "left")
              .join(broken, "job_id", "left").join(blocked, "job_id", "left"))
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("_blocked"), "paused_quota")
        .when(F.col("processed") == F.col("total"), "done")
        .when(F.col("total") > 0, "running")
        .otherwise("queued"))
    return joined.select("job_id", status.alias("status"), "error")


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """The row of one job, no row when it is unknown."""
    return jobs.filter(F.col("job_id") == job_id)


def _latest(updates: DataFrame, *keys) -> DataFrame:
    seq = F.struct("updated_at", "n")
    if "first_seq" not in updates.columns:
        updates = updates.withColumn("first_seq", seq)
    names = [c for c in updates.columns if c not in {"id", "first_seq"}]
    picked = [
        (F.min_by(name, "first_seq") if name in _FROM_FIRST else F.max_by(name, seq)).alias(name)
        for name in names]
    return updates.groupBy("id", *keys).agg(*picked, F.min("first_seq").alias("first_seq"))


def job_upsert(updates: DataFrame) -> DataFrame:
    """Job rows after all updates in (updated_at, n) order: newest values, first file_id and created_at.

    `first_seq` keeps where a row began, so its own result can be merged with further updates.
    """
    return _latest(updates)


def coalesce_updates(updates: DataFrame, window: str = FLUSH_WINDOW) -> DataFrame:
    """The newest update per job in each flush window."""
    slot = F.window("updated_at", window)["start"].alias("window_start")
    return _latest(updates, slot)
