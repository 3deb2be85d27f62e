"""Every operator as a query over the given tables."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postaudit import schema as S
from postaudit.fixtures import BLOCKED, Views, job_name, job_number
from postaudit.functions import calls as C, criteria as Cr, paging as Pg, posts as Po, prompts as Pr
from postaudit.functions import responses as R, text as T
from postaudit.operators import dedupe, jobs, pending, policy, quota, routing, rules, serving
from postaudit.plans import audit
from postaudit.session import materialise
from postaudit.sources import archives as A

QUOTA_LIMIT = 600
QUOTA_DAY = dt.date(2024, 1, 1)
SHOWN = ["id", "tweet_id", "job_id", "flagged_at", "score", "url"]


def _run_ts() -> Column:
    return F.lit(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc))


def _joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def _value(column: Column) -> Column:
    return column.alias("value")


def _ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


# --- sources -----------------------------------------------------------------------------

def _raw(files: DataFrame) -> DataFrame:
    return A.parse_pieces(A.read_pieces(files))


def _tweets(v: Views) -> DataFrame:
    return A.parse_js_files(v.js_files).select(F.col("tweet.id_str").alias("tweet_id"), "tweet", "tweet.entities")


def archive_format(v: Views) -> DataFrame:
    files = v.zip_files.unionByName(v.js_files.select("path", "content"))
    return files.select("path", A.is_zip(F.col("content")).alias("is_zip"))


def archive_zip_member(v: Views) -> DataFrame:
    raw = _raw(v.zip_files)
    return raw.groupBy("path").agg(
        F.max("member").alias("member"),
        F.when(F.max("error").isNull(), F.count("tweet")).alias("posts"),
        F.concat(F.lit(S.ERROR_PREFIX), F.max("error")).alias("error"))


def archive_errors(v: Views) -> DataFrame:
    return A.bad_archives(_raw(v.damaged_files)).select("path", "error")


def archive_parse(v: Views) -> DataFrame:
    # Read by both sides of the join: unzip and parse once.
    raw = materialise(_raw(v.js_files))
    good = A.good_rows(raw, A.bad_archives(raw))
    name = F.split("path", "/")
    posts = A.normalise(good, _run_ts(), F.col("path")).drop("path").withColumnRenamed("job_id", "path")
    return rules.drop_reposts(posts).select(
        F.get(name, F.lit(0)).alias("job_id"), F.get(name, F.lit(1)).cast("bigint").alias("part"),
        "pos", "tweet_id", "text", _ntz(F.col("created_at")).alias("created_at"),
        *[_joined(c) for c in ("links", "hashtags", "mentions", "attachments")])


# --- rules and routing -------------------------------------------------------------------

def rule_score(v: Views) -> DataFrame:
    return rules.rule_scorer(v.originals).select("job_id", "tweet_id", "result.*").withColumn(
        "labels", F.array_join("labels", "|"))


def rule_flags(v: Views) -> DataFrame:
    flagged = rules.keep_flagged(rules.rule_scorer(v.originals))
    return flagged.select("job_id", "tweet_id", "result.score", "result.reason",
                          T.post_url(F.col("tweet_id")).alias("url"))


def _group(phrases: list[str]) -> Callable[[Views], DataFrame]:
    return lambda v: rules.group_hit(v.originals, phrases).select("tweet_id", "hit")


def _step(phrases: list[str], score: float, reason: str) -> Callable[[Views], DataFrame]:
    return lambda v: rules.group_hit(v.originals, phrases).filter("hit").select(
        "tweet_id", F.lit(score).alias("score"), F.lit(reason).alias("reason"))


def filter_blocked_phrase(v: Views) -> DataFrame:
    phrase = F.get(F.array(*[F.lit(p) for p in BLOCKED]), F.col("_rank"))
    return rules.bind_phrase(v.originals, BLOCKED).filter(F.col("_rank").isNotNull()).select(
        "tweet_id", phrase.alias("phrase"), F.concat(F.lit(S.REASON_BLOCKED), phrase).alias("reason"))


def _filter_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("filter_result").isNotNull()).select("job_id", "tweet_id", "filter_result.*")


def flagged_union(v: Views) -> DataFrame:
    flags = routing.flag_in_one_pass(v.posts_with_job, BLOCKED, v.flagged_at)
    return flags.select("job_id", "tweet_id", "filter_reason", "score", "reason", "url")


def policy_table(v: Views) -> DataFrame:
    """A policy of many phrases: all that stands between the punctuation marks of the benchmark's items."""
    pieces = v.table("benchmark").select("item_id", F.posexplode(F.split("text", r"[.,;:!?\n]")))
    table = pieces.select((F.col("item_id") * 100_000 + F.col("pos")).alias("rank"), F.trim("col").alias("phrase"))
    return policy.match_policy(v.originals, table).select("tweet_id", "phrase", "reason")


def _two_runs(v: Views) -> tuple[audit.Audit, audit.Audit]:
    """A run over every third post, then one over all of them that knows the first."""
    run_ts = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    known = v.jobs_in.select("job_id", "criteria")
    posts = v.originals.select("job_id", "tweet_id", "text", "created_at", "pos")
    first = audit.audit_posts(posts.filter(F.col("pos") % 3 == 0), known, BLOCKED, run_ts)
    before = audit.History(first.posts, first.flagged, first.scored, first.waiting)
    return first, audit.audit_posts(posts, known, BLOCKED, run_ts, before=before)


def second_run_flags(v: Views) -> DataFrame:
    first, second = _two_runs(v)
    return first.flagged.unionByName(second.flagged).select("job_id", "tweet_id", "filter_reason", "score", "reason")


# --- state -------------------------------------------------------------------------------

def _marked(v: Views) -> DataFrame:
    return pending.mark_processed(v.routed, v.scored)


def _admission(v: Views, state: DataFrame) -> DataFrame:
    return quota.admit(pending.pending(state), quota.room_left(v.scored, QUOTA_DAY, QUOTA_LIMIT))


def _criteria_columns(*more: str) -> list[Column]:
    return [F.col("criteria.tone").alias("tone"), F.col("criteria.exclude_politics").alias("exclude_politics"),
            F.array_join("criteria.forbidden_words", "|").alias("forbidden_words"),
            *[F.col(f"criteria.{m}").alias(m) for m in more]]


def job_status(v: Views) -> DataFrame:
    failed = v.jobs_in.filter(F.col("k") % 7 == 3).select(
        "job_id", F.lit(S.ERROR_PREFIX + S.ERROR_JSON).alias("error"))
    # Counters and admission read the same state.
    state = materialise(v.state)
    return jobs.job_status(v.jobs_in, jobs.job_progress(state), failed, _admission(v, state))


# --- external model ----------------------------------------------------------------------

def llm_prompt(v: Views) -> DataFrame:
    posts = pending.with_criteria(v.originals, v.jobs_in)
    return posts.select("tweet_id", Pr.build_prompt(
        F.col("text"), F.col("created_at"), F.col("criteria")).alias("prompt"))


def llm_envelope(v: Views) -> DataFrame:
    doc = F.col("doc_id")
    part = F.array(F.struct("text"))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(part.alias("parts")).alias("content"))).alias("candidates")))
    body = F.when(doc % 5 == 0, F.expr("'{\"candidates\": [' || source")).when(
        doc % 7 == 0, F.lit('{"candidates": []}')).otherwise(whole)
    opened = R.open_envelope(F.col("body"))
    return (v.table("documents").select("doc_id", body.alias("body")).select("doc_id", opened.alias("o"))
            .select("doc_id", F.col("o.text").alias("response"), F.col("o.error").alias("error")))


def _verdicts(v: Views) -> DataFrame:
    return v.responses.select("doc_id", R.parse_verdict(F.col("response")).alias("verdict"))


def _outcomes(v: Views) -> DataFrame:
    outcome = C.call_class(F.col("status"), F.col("body"), F.col("attempt"))
    return v.calls.select("call_id", "attempt", outcome.alias("class"))


_VIEWS: dict[str, Callable[[Views], DataFrame]] = {
    "archive_format": archive_format,
    "archive_zip_member": archive_zip_member,
    "archive_js": lambda v: A.parse_js_files(v.js_files).groupBy("path").agg(F.count("tweet").alias("posts")),
    "archive_errors": archive_errors,
    "archive_parse": archive_parse,
    "js_unwrap": lambda v: v.js_texts.select("tweet_id", _value(T.unwrap_js(F.col("js")))),
    "post_text": lambda v: _tweets(v).select(
        "tweet_id", _value(Po.post_text(F.col("tweet.full_text"), F.col("tweet.text")))),
    "post_created_at": lambda v: _tweets(v).select(
        "tweet_id", Po.parse_created_at(F.col("tweet.created_at")).alias("at")).select(
        "tweet_id", _value(_ntz(F.coalesce("at", _run_ts()))), F.col("at").isNotNull().alias("created_at_ok")),
    "post_links": lambda v: _tweets(v).select("tweet_id", _value(F.array_join(Po.links(F.col("entities.urls")), "|"))),
    "post_hashtags": lambda v: _tweets(v).select(
        "tweet_id", _value(F.array_join(Po.hashtags(F.col("entities.hashtags")), "|"))),
    "post_mentions": lambda v: _tweets(v).select(
        "tweet_id", _value(F.array_join(Po.mentions(F.col("entities.user_mentions")), "|"))),
    "post_attachments": lambda v: _tweets(v).select(
        "tweet_id", _value(F.array_join(Po.attachments(F.col("entities.media")), "|"))),
    "post_url": lambda v: v.posts.select("tweet_id", _value(T.post_url(F.col("tweet_id")))),
    "post_key": lambda v: v.posts.select("tweet_id", _value(T.post_key(F.col("job_id"), F.col("tweet_id")))),
    "flag_id": lambda v: v.posts.select(
        "tweet_id", _value(T.flag_id(F.col("job_id"), F.col("tweet_id"), F.lit(S.SCORER_REASON)))),
    "phrase_contains": lambda v: v.posts.select("tweet_id", _value(T.contains_phrase(F.col("text"), F.lit("Crypto")))),
    "array_json_roundtrip": lambda v: v.table("documents").select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        _value(T.array_to_json(F.array(job_name(job_number()), "lang", "source")))).withColumn(
        "restored", F.array_join(T.json_to_array(F.col("value")), "|")),
    "ts_rfc3339": lambda v: v.posts.select("tweet_id", _value(T.rfc3339(F.col("created_at")))).withColumn(
        "restored", _ntz(T.from_rfc3339(F.col("value")))),
    "retweet_filter": lambda v: v.originals.select("job_id", "tweet_id"),
    "parse_summary": lambda v: jobs.parse_summary(v.posts),
    "posts_dedup": lambda v: dedupe.keep_first(v.posts_dup).select("job_id", "tweet_id", "pos", "text"),
    "rule_abusive": _group(S.RULE_ABUSIVE),
    "rule_hate": _group(S.RULE_HATE),
    "rule_threat": _group(S.RULE_THREAT),
    "rule_score": rule_score,
    "rule_flags": rule_flags,
    "filter_blocked_phrase": filter_blocked_phrase,
    "policy_join": lambda v: policy.match_policy(v.originals, v.policy).select("tweet_id", "phrase", "reason"),
    "policy_table": policy_table,
    "second_run_flags": second_run_flags,
    "second_run_progress": lambda v: _two_runs(v)[1].progress,
    "filter_threat": _step(S.CASCADE_THREAT, 1.0, S.REASON_CASCADE_THREAT),
    "filter_hate": _step(S.CASCADE_HATE, 0.95, S.REASON_CASCADE_HATE),
    "filter_cascade": lambda v: _filter_rows(rules.apply_cascade(v.originals, BLOCKED)),
    "filter_gate": lambda v: _filter_rows(rules.apply_cascade(v.posts_with_job, BLOCKED, rules.has_own_criteria())),
    "route": lambda v: v.routed.select("job_id", "tweet_id", "route"),
    "route_summary": lambda v: routing.route_summary(v.routed),
    "flagged_union": flagged_union,
    "mark_processed": lambda v: _marked(v).select("job_id", "tweet_id", "needs_scoring", "processed"),
    "pending": lambda v: pending.pending(_marked(v)).select("job_id", "tweet_id"),
    "pending_topn": lambda v: pending.pending_top(_marked(v), 50).select("job_id", "tweet_id"),
    "resume_pending": lambda v: pending.resume_pending(v.originals, v.scored).select("job_id", "tweet_id"),
    "pending_with_criteria": lambda v: pending.with_criteria(
        pending.pending(_marked(v)).drop("criteria"), v.jobs_in).select("job_id", "tweet_id", *_criteria_columns()),
    "criteria_parse": lambda v: v.jobs_in.select("job_id", *_criteria_columns()),
    "criteria_default": lambda v: v.jobs_in.withColumn(
        "criteria", Cr.criteria_or_default(F.col("criteria"))).select("job_id", *_criteria_columns("exclude_threats")),
    "job_progress": lambda v: jobs.job_progress(v.state),
    "job_status": job_status,
    "job_upsert": lambda v: jobs.job_upsert(v.job_updates).select(
        "id", "file_id", "status", "created_at", "updated_at"),
    "job_updates_coalesced": lambda v: jobs.coalesce_updates(v.job_updates).select(
        "id", "window_start", "status", "created_at", "updated_at"),
    "quota_usage": lambda v: quota.quota_usage(v.scored),
    "quota_admission": lambda v: _admission(v, _marked(v)).select("job_id", "tweet_id", "admitted"),
    "quota_reset_at": lambda v: v.scored.select(
        F.to_date("scored_at").alias("day"), _ntz(Pg.quota_reset_at(F.col("scored_at"))).alias("reset_at")).distinct(),
    "flagged_list": lambda v: serving.flagged_list(v.flagged, "job-0").select(*SHOWN),
    "flagged_page": lambda v: serving.flagged_page(v.flagged, page=3, size=20).select(*SHOWN),
    "flagged_by_id": lambda v: serving.flagged_by_id(
        v.flagged.select(*SHOWN), hashlib.md5(b"job-0_3_llm_scorer").hexdigest()),
    "flagged_count": lambda v: serving.flagged_count(v.flagged),
    "flagged_count_rollup": lambda v: serving.flagged_count_rollup(v.flagged),
    "page_meta": lambda v: serving.page_meta(v.flagged, page=3, size=20),
    "export_urls": lambda v: serving.export_urls(v.flagged),
    "export_json": lambda v: serving.export_json_per_job(v.flagged),
    "llm_prompt": llm_prompt,
    "llm_envelope": llm_envelope,
    "llm_response": lambda v: _verdicts(v).select("doc_id", "verdict.*").withColumn(
        "labels", F.array_join("labels", "|")),
    "llm_batch_errors": lambda v: _verdicts(v).select(
        "doc_id", R.or_error_default(F.col("verdict")).alias("r")).select("doc_id", "r.*").withColumn(
        "labels", F.array_join("labels", "|")),
    "call_triage": lambda v: _outcomes(v).select("call_id", "class"),
    "retry_delay": lambda v: _outcomes(v).select(
        "call_id", C.retry_delay(F.col("class"), F.col("attempt")).alias("delay_s")),
}


def _query(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(Views(spark, folder))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in _VIEWS.items()}
