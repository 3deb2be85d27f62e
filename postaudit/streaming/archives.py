"""The audit as a stream: a folder that keeps receiving archives."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from postaudit import schema as S
from postaudit.operators.dedupe import keep_first
from postaudit.operators.jobs import job_upsert, progress_from_counts
from postaudit.operators.routing import Policy
from postaudit.operators.rules import drop_reposts, rule_scorer
from postaudit.operators.scoring import Scorer
from postaudit.plans.audit import History, audit_posts, empty_history
from postaudit.session import folder_exists, materialise
from postaudit.sources.archives import ingest, with_long_files
from postaudit.sources.tables import job_bucket, write_by_id, write_by_job
from postaudit.streaming.segments import EVERY, compact, read_merged, read_places, segments

COMPACT_EVERY = 50
"""Batches after which the changed job rows are merged into a new whole table."""


def watch_archives(spark: SparkSession, folder: str, max_files: int = 100, max_bytes: int | None = None,
                   done: str | None = None) -> DataFrame:
    """New files of `folder`, at most `max_files` per micro-batch; a long file comes without its bytes, see with_long_files.

    With `max_bytes` a micro-batch instead takes files up to that size in all, and one at least. Files that are audited move
    to the folder `done`, if it is given, so that the watched one stays small to list.
    """
    reader = spark.readStream.format("binaryFile").schema(S.ARCHIVE_FILE)
    reader = (reader.option("maxFilesPerTrigger", max_files) if max_bytes is None
              else reader.option("maxBytesPerTrigger", max_bytes))
    if done is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return with_long_files(reader.load(folder))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch under its own number; a batch run again replaces its own rows only."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _merge_tables(spark: SparkSession, tables: str, batch_id: int, every: int) -> None:
    """Merge the index and the flags by id of the batches before `batch_id`, where a period has ended."""
    compact(spark, f"{tables}/counts", f"{tables}/counts_merged", S.COUNTS_DDL, batch_id,
            lambda rows, path: write_by_job(rows, path, "overwrite"), every)
    compact(spark, f"{tables}/flagged", f"{tables}/flagged_by_id", S.FLAGGED_DDL, batch_id,
            lambda rows, path: write_by_id(rows, path, "overwrite"), every)


def _index(spark: SparkSession, tables: str, batch_id: int, every: int) -> DataFrame:
    """What each batch before `batch_id` added to the counters of each job that it touched."""
    return read_merged(spark, f"{tables}/counts", f"{tables}/counts_merged", f"{S.COUNTS_DDL}, job_bucket INT", batch_id, every)


def _history(spark: SparkSession, tables: str, batch_id: int, posts: DataFrame, failed: DataFrame, last: int | None,
             every: int) -> History:
    """What the batches before this one have of the jobs of `posts` and `failed`, and the posts that wait.

    The index says which batches have posts of these jobs; only their folders of these jobs' buckets are read, and
    counters are added up, not counted again. Archives of new jobs read no earlier post, however long the stream
    has run. A batch that is run again sees what it saw before.
    """
    none = empty_history(spark, posts)
    if last is None:
        return none
    waiting = spark.read.schema(none.waiting.schema).parquet(f"{tables}/waiting/batch_id={last}")
    touched = posts.select("job_id").union(waiting.select("job_id")).union(failed.select("job_id")).distinct()
    touched = materialise(touched)
    buckets = [r[0] for r in touched.select(job_bucket(F.col("job_id"))).distinct().collect()]  # 64 at most
    known = _index(spark, tables, batch_id, every).filter(F.col("job_bucket").isin(buckets))
    known = materialise(known.join(touched, "job_id", "left_semi"))
    again = known.join(posts.select("job_id").distinct(), "job_id", "left_semi").filter("posts > 0")
    earlier = read_places(spark, f"{tables}/posts", _ddl(posts), again, "job_bucket")
    # A waiting post has no score yet: a batch leaves out what it scored.
    return History(earlier, none.flagged, none.scored, waiting, known.select("job_id", *S.COUNTS))


def _ddl(like: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)


def _used(spark: SparkSession, tables: str, batch_id: int, day: dt.date) -> int:
    """Calls of `day` in the batches before, from the small table of daily numbers."""
    calls = spark.read.schema("day DATE, calls BIGINT, batch_id INT").parquet(f"{tables}/calls")
    return calls.filter((F.col("batch_id") < batch_id) & (F.col("day") == F.lit(day))).agg(F.sum("calls")).first()[0] or 0


def audit_batch(spark: SparkSession, files: DataFrame | None, jobs: DataFrame, policy: Policy, tables: str, batch_id: int,
                now: dt.datetime, scorer: Scorer = rule_scorer, quota: int | None = None, all_parts: bool = False,
                max_bytes: int | None = None, every: int = EVERY, **options) -> None:
    """One step of the stream: audit `files` and the waiting posts, and write every table under `batch_id`.

    The tables are posts, flagged, scored, waiting, bad_archives, bad_rows, jobs (status and counters of the
    jobs that the batch has touched), counts (what it adds to their counters) and calls per day. Each `every` batch numbers the
    counts, and the flags as a layout by id, are merged, see `compact`. `files` may be None, to take up waiting posts when no file
    comes (a scheduled call, with a `batch_id` above the last). See ingest and audit_posts for the options.
    """
    if files is None:
        files = spark.createDataFrame([], S.ARCHIVE_FILE)
    read = ingest(files, now, all_parts=all_parts, max_bytes=max_bytes)
    posts = materialise(keep_first(drop_reposts(read.posts)))
    last = last_batch(spark, tables, batch_id)
    if last is not None:
        _merge_tables(spark, tables, batch_id, every)
    failed = materialise(read.bad_archives)
    before = _history(spark, tables, batch_id, posts, failed, last, every)
    room = quota
    if quota is not None and last is not None:
        room = max(quota - _used(spark, tables, batch_id, now.astimezone(dt.timezone.utc).date()), 0)
    audit = audit_posts(posts, jobs, policy, now, scorer, before, failed=failed, bad_rows=read.bad_rows,
                        room=room, **options)
    for name, rows in {"posts": audit.posts, "flagged": audit.flagged, "scored": audit.new_scores, "counts": audit.counts}.items():
        write_by_job(rows, f"{tables}/{name}/batch_id={batch_id}", mode="overwrite")
    touched = audit.progress.select("job_id").union(failed.select("job_id")).distinct()
    state = audit.status.join(touched, "job_id", "left_semi").join(audit.progress, "job_id", "left").withColumn("as_of", F.lit(now))
    calls = audit.new_scores.groupBy(F.to_date("scored_at").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    for name, rows in {"waiting": audit.waiting, "bad_archives": audit.bad_archives, "bad_rows": audit.bad_rows,
                       "jobs": state, "calls": calls, "batches": spark.range(1).select(F.lit(now).alias("at"))}.items():
        write_batch(rows, f"{tables}/{name}", batch_id)  # `batches` comes last and marks the batch as whole


def last_batch(spark: SparkSession, tables: str, before: int = 1 << 62) -> int | None:
    """The number of the last whole batch below `before`, None if there is none."""
    if not folder_exists(spark, f"{tables}/batches"):
        return None
    made = spark.read.schema("at TIMESTAMP, batch_id BIGINT").parquet(f"{tables}/batches")
    return made.filter(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]


def audit_stream(files: DataFrame, jobs: DataFrame | Callable[[DataFrame], DataFrame], policy: Policy,
                 tables: str, checkpoint: str, scorer: Scorer = rule_scorer, quota: int | None = None,
                 clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc), **options) -> DataStreamWriter:
    """Audit each micro-batch of files into `tables`, see audit_batch.

    `jobs` is the table of job_id and criteria, or makes it from the files of a batch. Posts beyond the
    `quota`, or sent back by the scorer, wait with their criteria and are taken up by the next micro-batch,
    or by `resume`. A post that an earlier batch has is not stored, scored or flagged again. Start the result with
    a trigger: availableNow to drain the folder and stop, processingTime to keep watching.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        # Numbers are doubled, so that a resume between two batches has a place.
        known = jobs if isinstance(jobs, DataFrame) else jobs(batch)
        audit_batch(batch.sparkSession, batch, known, policy, tables, 2 * batch_id, clock(), scorer, quota, **options)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def resume(spark: SparkSession, jobs: DataFrame, policy: Policy, tables: str, scorer: Scorer = rule_scorer,
           quota: int | None = None, now: dt.datetime | None = None, **options) -> None:
    """Take up waiting posts without new files, for instance after the quota's reset, while no stream is running.

    Repeating it before the next micro-batch replaces what it wrote.
    """
    last = last_batch(spark, tables)
    if last is not None:
        audit_batch(spark, None, jobs, policy, tables, last + 1 - last % 2, now or dt.datetime.now(dt.timezone.utc), scorer, quota,
                    **options)


def _next(spark: SparkSession, tables: str) -> int:
    last = last_batch(spark, tables)
    return 0 if last is None else last + 1


def stream_progress(spark: SparkSession, tables: str, every: int = EVERY) -> DataFrame:
    """Counters per job over all batches written so far, added up from what each of them counted."""
    return progress_from_counts(_index(spark, tables, _next(spark, tables), every).select("job_id", *S.COUNTS))


def stream_flags(spark: SparkSession, tables: str, every: int = EVERY) -> DataFrame:
    """All flags of the batches written so far; a filter on the id reads a row group of each of a few segments, and the
    batches since the last period. See serving.flagged_by_id."""
    return read_merged(spark, f"{tables}/flagged", f"{tables}/flagged_by_id", S.FLAGGED_DDL, _next(spark, tables), every)


def stream_status(spark: SparkSession, tables: str, jobs: DataFrame | None = None) -> DataFrame:
    """The last status and counters of each job that a batch has touched; others of `jobs`, if it is given, are queued."""
    made = spark.read.parquet(f"{tables}/jobs")
    rest = [c for c in made.columns if c not in ("job_id", "batch_id")]
    last = made.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select("job_id", "s.*")
    if jobs is None:
        return last
    queued = jobs.select("job_id").distinct().join(last.select("job_id"), "job_id", "left_anti")
    return last.unionByName(queued.withColumn("status", F.lit("queued")), allowMissingColumns=True)


def upsert_stream(updates: DataFrame, snapshots: str, checkpoint: str, every: int = COMPACT_EVERY) -> DataStreamWriter:
    """Keep job rows current: each micro-batch writes the rows that it changes, `job_rows` merges them.

    After `every` batches the rows are merged into a whole table, which later reads start from. Both are
    folders of their own number, so a batch run again reads what it read before.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        job_upsert(batch).write.mode("overwrite").parquet(f"{snapshots}/changes/batch_id={batch_id}")
        if batch_id % every == every - 1:
            job_rows(batch.sparkSession, snapshots, batch_id, every).write.mode("overwrite").parquet(
                f"{snapshots}/whole/{batch_id // every}")

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def job_rows(spark: SparkSession, snapshots: str, batch_id: int, every: int = COMPACT_EVERY) -> DataFrame:
    """Job rows after the batch `batch_id`: the last whole table before it and the changes since."""
    whole = batch_id // every - 1
    changes = spark.read.option("basePath", f"{snapshots}/changes").parquet(f"{snapshots}/changes")
    rows = changes.filter(F.col("batch_id").between((whole + 1) * every, batch_id)).drop("batch_id")
    if whole >= 0:
        rows = spark.read.parquet(f"{snapshots}/whole/{whole}").unionByName(rows)
    return job_upsert(rows)


def daily_calls(scored: DataFrame, late: str = "1 day") -> DataFrame:
    """Running number of calls per day of `scored_at`; days close `late` after their end."""
    return (scored.withWatermark("scored_at", late).groupBy(F.window("scored_at", "1 day"))
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(F.to_date("window.start").alias("day"), "calls"))
