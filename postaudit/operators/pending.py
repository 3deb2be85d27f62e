"""What still waits for a score, derived from the tables instead of updated flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postaudit.functions.criteria import criteria_or_default
from postaudit.operators.dedupe import POST_KEY
from postaudit.operators.joins import join_by_job, match_keys
from postaudit.operators.routing import NEEDS_SCORING

QUEUE_ORDER = ("created_at", "pos", "job_id", "tweet_id")


def mark_processed(routed: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds needs_scoring and processed: a post is processed when flagged by filter, skipped or scored."""
    done = scored.select(*POST_KEY).distinct().withColumn("_scored", F.lit(True))
    needs = F.col("route") == NEEDS_SCORING
    return (routed.join(done, list(POST_KEY), "left")
            .withColumn("needs_scoring", needs)
            .withColumn("processed", ~needs | F.col("_scored").isNotNull())
            .drop("_scored"))


def pending(state: DataFrame) -> DataFrame:
    return state.filter(F.col("needs_scoring") & ~F.col("processed"))


def pending_top(state: DataFrame, n: int) -> DataFrame:
    return pending(state).orderBy(*QUEUE_ORDER).limit(n)


def resume_pending(posts: DataFrame, scored: DataFrame) -> DataFrame:
    """Posts without a score; running it again after a stop goes on where the scores end."""
    return match_keys(posts, scored, POST_KEY, "left_anti")


def with_criteria(waiting: DataFrame, jobs: DataFrame) -> DataFrame:
    """Waiting posts with their job's criteria, the defaults where it has none; unknown jobs drop out."""
    known = jobs.select("job_id", "criteria")
    return join_by_job(waiting, known).withColumn("criteria", criteria_or_default(F.col("criteria")))
