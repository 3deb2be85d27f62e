"""Where each post goes after filtering, and the flag rows both producers write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postaudit import schema as S
from postaudit.functions.text import bind_lowered, flag_id, post_url
from postaudit.operators.rules import (
    apply_cascade, apply_policy_cascade, bind_hits, bind_step, cascade_result, has_own_criteria, keep_flagged, rule_result)

FLAGGED, NEEDS_SCORING, PROCESSED = "flagged_now", "needs_scoring", "processed"


Policy = Sequence[str] | DataFrame | None


def route(posts: DataFrame, policy: Policy, scorer_present: bool = True, whole_words: bool = False,
          forbidden_words: bool = False) -> DataFrame:
    """Adds `filter_result` and `route` to posts that carry their job's criteria.

    `policy` is a list of phrases, a table (rank, phrase) of any size, or None: without a policy no filter
    applies, the fixed ones neither. See apply_cascade for `whole_words` and `forbidden_words`.
    """
    rest = NEEDS_SCORING if scorer_present else PROCESSED
    if policy is None:
        nothing = F.lit(None).cast("struct<filter_reason: string, score: double, reason: string>")
        judged = posts.withColumn("filter_result", nothing)
    elif isinstance(policy, DataFrame):
        judged = apply_policy_cascade(posts, policy, has_own_criteria(), whole_words, forbidden_words)
    else:
        judged = apply_cascade(posts, policy, has_own_criteria(), whole_words, forbidden_words)
    return judged.withColumn(
        "route", F.when(F.col("filter_result").isNotNull(), FLAGGED).otherwise(rest))


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("job_id").agg(
        F.count_if(F.col("route") == NEEDS_SCORING).alias("needs_scoring"),
        F.count_if(F.col("route") == FLAGGED).alias("flagged_now"))


def flag_rows(hits: DataFrame, verdict: str, filter_reason: Column, flagged_at: Column) -> DataFrame:
    """Rows of the flag table from posts whose struct column `verdict` holds score and reason."""
    return hits.select(
        flag_id(F.col("job_id"), F.col("tweet_id"), filter_reason).alias("id"),
        "tweet_id", "job_id", "text", "created_at",
        flagged_at.alias("flagged_at"),
        F.col(f"{verdict}.reason").alias("reason"),
        F.col(f"{verdict}.score").alias("score"),
        post_url(F.col("tweet_id")).alias("url"),
        filter_reason.alias("filter_reason"))


def filter_flags(routed: DataFrame, flagged_at: Column) -> DataFrame:
    hits = routed.filter(F.col("filter_result").isNotNull())
    return flag_rows(hits, "filter_result", F.col("filter_result.filter_reason"), flagged_at)


def scorer_flags(scored: DataFrame, flagged_at: Column) -> DataFrame:
    return flag_rows(keep_flagged(scored), "result", F.lit(S.SCORER_REASON), flagged_at)


def union_flags(by_filter: DataFrame, by_scorer: DataFrame) -> DataFrame:
    return by_filter.unionByName(by_scorer)


def flag_in_one_pass(posts: DataFrame, phrases: Sequence[str], flagged_at: Column) -> DataFrame:
    """The same rows as the union when the scorer is the built-in one, reading the posts once."""
    stepped = bind_step(bind_lowered(posts), phrases, has_own_criteria())
    kept = bind_hits(stepped, F.col("_step").isNull()).filter(F.col("_step").isNotNull() | (F.col("_hits") > 0))
    filtered = cascade_result(F.col("_step"), phrases)
    scored = rule_result(F.col("_hits"))
    judged = kept.withColumn("_verdict", F.struct(
        F.coalesce(filtered["score"], scored["score"]).alias("score"),
        F.coalesce(filtered["reason"], scored["reason"]).alias("reason"),
        F.coalesce(filtered["filter_reason"], F.lit(S.SCORER_REASON)).alias("filter_reason")))
    return flag_rows(judged, "_verdict", F.col("_verdict.filter_reason"), flagged_at)
