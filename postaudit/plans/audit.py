"""The whole audit of a set of archives, from files to flags and job rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postaudit import schema as S
from postaudit.functions.criteria import criteria_or_default
from postaudit.functions.text import bind_lowered
from postaudit.operators.dedupe import POST_KEY, keep_first
from postaudit.operators.jobs import count_changes, job_status, progress_from_counts
from postaudit.operators.joins import join_by_job, match_keys
from postaudit.operators.pending import resume_pending
from postaudit.operators.quota import admit, room_left
from postaudit.operators.routing import NEEDS_SCORING, Policy, filter_flags, route, scorer_flags, union_flags
from postaudit.operators.rules import bind_hits, drop_reposts, rule_result, rule_scorer
from postaudit.operators.scoring import SCORED, WAITING, Scorer
from postaudit.session import folder_exists, materialise
from postaudit.sources.archives import ingest
from postaudit.sources.tables import write_by_id, write_by_job


@dataclass(frozen=True)
class History:
    """What earlier runs have left: all their posts, flags and scores, and the posts that still wait for a score.

    `counts` holds what they added to the counters; without it the counters are made from the tables once more.
    """

    posts: DataFrame
    flagged: DataFrame
    scored: DataFrame
    waiting: DataFrame
    counts: DataFrame | None = None


@dataclass(frozen=True)
class Audit:
    """Result tables of a run: its new posts, flags and scores, and the posts that wait after it, with criteria.

    `scored`, `progress` and `status` cover earlier runs as well; `counts` is what this run adds to the counters.
    """

    posts: DataFrame
    flagged: DataFrame
    scored: DataFrame
    new_scores: DataFrame
    waiting: DataFrame
    progress: DataFrame
    status: DataFrame
    bad_archives: DataFrame
    bad_rows: DataFrame
    counts: DataFrame


def audit_archives(files: DataFrame, jobs: DataFrame, policy: Policy, run_ts: dt.datetime,
                   job_id: Column | None = None, all_parts: bool = False, max_bytes: int | None = None, **options) -> Audit:
    """Ingest `files` and audit their posts, see ingest and audit_posts. `jobs` holds job_id and criteria.

    The distinct originals are written once; every later step reads that table.
    """
    read = ingest(files, run_ts, job_id, all_parts, max_bytes)
    posts = materialise(keep_first(drop_reposts(read.posts)))
    return audit_posts(posts, jobs, policy, run_ts, failed=read.bad_archives, bad_rows=read.bad_rows, **options)


def run_numbers(spark: SparkSession, path: str) -> dict[str, int]:
    """The number of each run saved under `path`, in the order in which they were first saved; one row a run."""
    if not folder_exists(spark, f"{path}/runs"):
        return {}
    saved = spark.read.schema("number BIGINT, run STRING").parquet(f"{path}/runs")
    return {r.run: r.number for r in saved.collect()}


def save_audit(audit: Audit, path: str, run: str) -> None:
    """Write the tables of one run under `path`/<table>/run=<run>; saving again replaces that run only.

    Runs that are given the earlier ones as History leave one row per post and per flag over all of them. A run keeps
    the number that it got when it was first saved, and `runs`, written last, marks it as whole.
    """
    spark = audit.posts.sparkSession
    numbers = run_numbers(spark, path)
    for name in ("posts", "flagged", "new_scores"):
        write_by_job(getattr(audit, name), f"{path}/{name}/run={run}", mode="overwrite")
    write_by_id(audit.flagged, f"{path}/flagged_by_id/run={run}", mode="overwrite")
    for name in ("waiting", "bad_archives", "bad_rows", "counts"):
        getattr(audit, name).write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    audit.status.join(audit.progress, "job_id", "left").write.mode("overwrite").parquet(f"{path}/jobs/run={run}")
    number = numbers.get(run, max(numbers.values(), default=0) + 1)
    spark.range(1).select(F.lit(number).cast("bigint").alias("number")).write.mode("overwrite").parquet(f"{path}/runs/run={run}")


def load_history(spark: SparkSession, path: str, run: str) -> History:
    """The tables of the runs that were saved before `run` first was, or of all if it is new; the last left the waiting posts.

    Runs are ordered by the number that saving gave them, whatever their names, so saving `run` again starts from
    the same history. Without an earlier run there is no history, which is an error: leave `before` out.
    """
    numbers = run_numbers(spark, path)
    earlier = [n for n, at in numbers.items() if at < numbers.get(run, at + 1)]
    if not earlier:
        raise ValueError(f"no run was saved in {path} before {run}")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").withColumn("run", F.col("run").cast("string")).filter(F.col("run").isin(earlier))

    # Runs saved before there were counts have none; their counters come from the tables.
    counted = all(folder_exists(spark, f"{path}/counts/run={n}") for n in earlier)
    counts = table("counts").drop("run") if counted else None
    last = max(earlier, key=numbers.get)
    plain = [table(n).drop("run", "job_bucket") for n in ("posts", "flagged", "new_scores")]
    return History(*plain, table("waiting").filter(F.col("run") == last).drop("run"), counts)


def _score_rows(scored: DataFrame, stamp: Column) -> DataFrame:
    """Rows of the score table; the text is kept only where the flag table needs it."""
    if "score_status" not in scored.columns:
        scored = scored.withColumn("score_status", F.lit(SCORED)).withColumn(
            "score_error", F.lit(None).cast("string"))
    return scored.select(
        "job_id", "tweet_id", F.when(F.col("result.should_flag"), F.col("text")).alias("text"),
        "created_at", "result", "score_status", "score_error", stamp.alias("scored_at"))


def judge(posts: DataFrame, policy: Policy, scorer: Scorer, **options) -> DataFrame:
    """One row per post with route and filter_result, and for the built-in scorer also result, written once.

    Flags, waiting posts and counters are all derived from it. The built-in scorer judges in the same pass and
    then only flagged texts are kept; another scorer needs the texts of all posts that are to be scored.
    """
    judged, keep = route(posts, policy, **options), F.lit(True)
    if scorer is rule_scorer:
        hits = bind_hits(bind_lowered(judged), F.col("route") == NEEDS_SCORING)
        judged = hits.withColumn("result", F.when(F.col("_hits").isNotNull(), rule_result(F.col("_hits"))))
        keep = F.col("filter_result").isNotNull() | F.coalesce(F.col("result.should_flag"), F.lit(False))
    names = [*POST_KEY, "created_at", "pos", "criteria", "route", "filter_result",
             *["result"] * (scorer is rule_scorer)]
    return materialise(judged.select(*names, F.when(keep, F.col("text")).alias("text")))


def audit_posts(posts: DataFrame, jobs: DataFrame, policy: Policy, run_ts: dt.datetime,
                scorer: Scorer = rule_scorer, before: History | None = None,
                quota: int | None = None, failed: DataFrame | None = None,
                bad_rows: DataFrame | None = None, room: int | None = None, whole_words: bool = False,
                forbidden_words: bool = False) -> Audit:
    """Filter, score and flag distinct original posts; see apply_cascade for `whole_words` and `forbidden_words`.

    Posts that an earlier run (`before`) has are left out, and its waiting posts taken up, with the criteria
    they came with. A job that `jobs` does not name counts as one without criteria, and has a status as any
    other. Calls of the day count against `quota`, the daily limit of a paid scorer (schema.DAILY_QUOTA as
    a rule; None is no limit), unless the caller knows the `room` that is left; posts that the scorer itself sends back wait too. Scores are written once;
    flags, counters and status read the written copy.
    """
    spark = posts.sparkSession
    if failed is None:
        failed = spark.createDataFrame([], "job_id STRING, path STRING, error STRING")
    if bad_rows is None:
        bad_rows = spark.createDataFrame([], "job_id STRING, path STRING, member STRING, pos BIGINT")
    stamp = F.lit(run_ts)
    known = jobs.select("job_id", "criteria")
    fresh, work = posts, join_by_job(posts, known, "left")
    if before is not None:
        fresh = materialise(match_keys(posts, before.posts, POST_KEY, "left_anti"))
        again = resume_pending(before.waiting, before.scored)
        work = join_by_job(fresh, known, "left").unionByName(again.select(*posts.columns, "criteria"))
    verdicts = judge(work, policy, scorer, whole_words=whole_words, forbidden_words=forbidden_words)
    waiting = verdicts.filter(F.col("route") == NEEDS_SCORING)
    chosen, kept_back = waiting, waiting.limit(0).select(*POST_KEY)
    if room is None and quota is not None:
        room = quota if before is None else room_left(before.scored, run_ts.astimezone(dt.timezone.utc).date(), quota)
    if room is not None:
        placed = materialise(admit(waiting, room))
        chosen = match_keys(waiting, placed.filter("admitted"), POST_KEY, "left_semi")
        kept_back = placed.filter("NOT admitted").select(*POST_KEY)
    if scorer is not rule_scorer:
        chosen = scorer(chosen.select(*POST_KEY, "text", "created_at",
                                      criteria_or_default(F.col("criteria")).alias("criteria")))
    answered = materialise(_score_rows(chosen, stamp))
    now = answered.filter(F.col("score_status") != WAITING)
    kept_back = kept_back.unionByName(answered.filter(F.col("score_status") == WAITING).select(*POST_KEY))
    later = match_keys(work, kept_back, POST_KEY, "left_semi").select(*posts.columns, "criteria")
    flagged = union_flags(filter_flags(verdicts, stamp), scorer_flags(now, stamp))
    counts = materialise(count_changes(fresh, flagged, now))
    every, changes = now, counts
    if before is not None:
        every = before.scored.select(*now.columns).unionByName(now)
        earlier = before.counts
        if earlier is None:
            earlier = count_changes(before.posts, before.flagged, before.scored)
        changes = earlier.select(*counts.columns).unionByName(counts)
    progress = progress_from_counts(changes)
    named = known.select("job_id").union(progress.select("job_id")).union(failed.select("job_id")).distinct()
    status = job_status(named, progress, failed, later.select("job_id", F.lit(False).alias("admitted")))
    return Audit(fresh, flagged, every, now, later, progress, status, failed, bad_rows, counts)


def empty_history(spark: SparkSession, posts: DataFrame) -> History:
    """The history of a first run."""
    none = posts.limit(0)
    return History(none, spark.createDataFrame([], S.FLAGGED_DDL), spark.createDataFrame([], S.SCORED_DDL),
                   none.withColumn("criteria", F.lit(None).cast(f"struct<{S.CRITERIA_DDL}>")))
