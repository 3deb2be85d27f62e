"""Streams over folders: same result as the batch, restart adds nothing, quota carries over."""

import datetime as dt
import json

from pyspark.sql import functions as F

from postaudit.functions.criteria import parse_criteria
from postaudit.operators import jobs
from postaudit.operators.serving import flagged_by_id
from postaudit.plans.audit import audit_archives
from postaudit.sources.archives import job_of_path, scan_archives
from postaudit.streaming import archives as St

NOW = dt.datetime(2024, 5, 1, 12)
TEXTS = ["fine", "you idiot", "kys", "RT @a: I hate", "crypto", "I hate it"]


def write_archive(folder, name, first, n=6):
    posts = [{"tweet": {"id_str": str(first + i), "full_text": TEXTS[i % 6],
                        "created_at": "Mon Jan 02 15:04:05 +0000 2023"}} for i in range(n)]
    (folder / f"{name}.js").write_text("window.YTD.tweets.part0 = " + json.dumps(posts) + ";")


def short(job):
    return job.rsplit("/", 1)[-1].removesuffix(".js")


def jobs_of(files):
    return files.select(job_of_path().alias("job_id")).withColumn("criteria", parse_criteria(F.lit('{"tone": "calm"}')))


def start(spark, folder, out, **options):
    files = St.watch_archives(spark, str(folder), max_files=2)
    query = St.audit_stream(files, jobs_of, ["Crypto"], f"{out}/tables", f"{out}/checkpoint",
                            **{"clock": lambda: NOW, **options}).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def flags(spark, out):
    return sorted((short(r.job_id), r.tweet_id, r.filter_reason) for r in spark.read.parquet(f"{out}/tables/flagged").collect())


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        write_archive(folder, f"job{i}", 100 * i)
    (folder / "bad.js").write_text("nothing here")
    assert start(spark, folder, tmp_path) == 2
    batch = audit_archives(scan_archives(spark, str(folder)), jobs_of(scan_archives(spark, str(folder))), ["Crypto"], NOW)
    expected = sorted((short(r.job_id), r.tweet_id, r.filter_reason) for r in batch.flagged.collect())
    assert len(expected) == 12 and flags(spark, tmp_path) == expected
    assert [short(r.job_id) for r in spark.read.parquet(f"{tmp_path}/tables/bad_archives").collect()] == ["bad"]
    assert {short(r.job_id): r.status for r in batch.status.collect()} == {
        "bad": "failed", "job0": "done", "job1": "done", "job2": "done"}
    assert start(spark, folder, tmp_path) == 0 and flags(spark, tmp_path) == expected
    write_archive(folder, "job9", 900)
    assert start(spark, folder, tmp_path) == 1
    assert len(flags(spark, tmp_path)) == 16
    counts = {short(r.job_id): (r.total, r.processed, r.flagged) for r in St.stream_progress(spark, f"{tmp_path}/tables").collect()}
    assert counts == {j: (5, 5, 4) for j in ("job0", "job1", "job2", "job9")}


def test_quota_carries_over(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    known = spark.createDataFrame([(f"{folder}/job{i}.js",) for i in range(9)], "job_id STRING").withColumn(
        "criteria", parse_criteria(F.lit('{"tone": "calm"}')))
    files = St.watch_archives(spark, str(folder), max_files=1)
    day = iter(NOW + dt.timedelta(days=i) for i in range(100))
    for i in range(3):
        write_archive(folder, f"job{i}", 100 * i, n=6 if i == 0 else 1)
        query = St.audit_stream(files, known, ["Crypto"], f"{tmp_path}/tables", f"{tmp_path}/checkpoint", quota=2,
                                clock=lambda: next(day)).trigger(availableNow=True).start()
        query.awaitTermination()
    scored = [(short(r.job_id), r.tweet_id) for r in spark.read.parquet(f"{tmp_path}/tables/scored").collect()]
    # Three of job0 need a score, one each of the others: two per day.
    assert len(scored) == len(set(scored)) == 5
    assert sorted(scored) == [("job0", "0"), ("job0", "1"), ("job0", "5"), ("job1", "100"), ("job2", "200")]
    assert {(j, t) for j, t, _ in flags(spark, tmp_path)} == {("job0", t) for t in ("1", "2", "4", "5")}
    assert len(flags(spark, tmp_path)) == 4


def test_waiting_posts_of_an_earlier_batchs_jobs_are_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_archive(folder, "a", 0)
    assert start(spark, folder, tmp_path, quota=1) == 1
    write_archive(folder, "b", 100, n=1)
    start(spark, folder, tmp_path, quota=1)
    tables = f"{tmp_path}/tables"
    last = St.last_batch(spark, tables)
    waiting = spark.read.parquet(f"{tables}/waiting/batch_id={last}")
    assert {short(r.job_id) for r in waiting.collect()} == {"a", "b"} and waiting.count() == 3
    state = {short(r.job_id): r.status for r in St.stream_status(spark, tables).collect()}
    assert state == {"a": "paused_quota", "b": "paused_quota"}
    # No new file comes: a scheduled call after the reset takes them up.
    none = spark.createDataFrame([], "job_id STRING").withColumn("criteria", parse_criteria(F.lit("{}")))
    for _ in range(2):
        St.resume(spark, none, ["Crypto"], tables, quota=10, now=NOW + dt.timedelta(days=1))
    assert spark.read.parquet(f"{tables}/waiting/batch_id={St.last_batch(spark, tables)}").count() == 0
    assert {r.status for r in St.stream_status(spark, tables).collect()} == {"done"}
    scored = spark.read.parquet(f"{tables}/scored")
    assert scored.count() == scored.select("job_id", "tweet_id").distinct().count() == 4


def test_a_post_that_comes_again_is_one_row(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    job = lambda files: files.select(F.lit("job").alias("job_id")).distinct().withColumn(
        "criteria", parse_criteria(F.lit('{"tone": "calm"}')))
    for i, day in enumerate((NOW, NOW + dt.timedelta(days=1))):
        (tmp_path / "copy").mkdir(exist_ok=True)
        write_archive(tmp_path / "copy", "same", 0)
        posts = St.ingest(scan_archives(spark, str(tmp_path / "copy")), day, F.lit("job"))
        St.audit_batch(spark, scan_archives(spark, str(tmp_path / "copy")), job(posts.posts), ["Crypto"],
                       f"{tmp_path}/tables", 2 * i, day)
    for table in ("posts", "flagged", "scored"):
        rows = spark.read.parquet(f"{tmp_path}/tables/{table}")
        assert rows.count() == rows.select("tweet_id").distinct().count() > 0


def test_bad_rows_are_written(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "odd.js").write_text('x = [null, {"tweet": {"full_text": "no id"}}, {"tweet": {"id_str": "1", "full_text": "kys"}}];')
    start(spark, folder, tmp_path)
    assert sorted(r.pos for r in spark.read.parquet(f"{tmp_path}/tables/bad_rows").collect()) == [0, 1]


def test_upsert_stream(spark, tmp_path):
    folder = str(tmp_path / "updates")
    ddl = "id STRING, file_id STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP, n BIGINT"
    rows = [(f"j{i % 2}", f"f{i}", f"s{i}", NOW + dt.timedelta(seconds=i), NOW + dt.timedelta(seconds=i), i) for i in range(9)]
    everything = spark.createDataFrame(rows, ddl)
    for part in range(3):
        everything.filter(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ddl).parquet(folder)
        St.upsert_stream(stream, f"{tmp_path}/snap", f"{tmp_path}/ck", every=2).trigger(availableNow=True).start().awaitTermination()
    last = St.job_rows(spark, f"{tmp_path}/snap", 2, 2)
    assert sorted(last.collect()) == sorted(jobs.job_upsert(everything).select(*last.columns).collect())
    assert (tmp_path / "snap/whole/0").exists()


def test_daily_calls_on_events(spark):
    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(source)
    counted = St.daily_calls(stream.withColumn("scored_at", F.col("ts").cast("timestamp")))
    query = counted.writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = events.groupBy(F.to_date("ts").alias("day")).count()
    assert sorted(spark.table("calls").collect()) == sorted(expected.collect())


def test_segments_are_few_and_cover_whole_periods():
    for n in range(0, 2000, 7):
        made = St.segments(n, 10)
        assert [a for a, _ in made] == [0, *[b for _, b in made]][:len(made)]
        assert (made[-1][1] if made else 0) == n // 10 * 10 and len(made) <= (n // 10).bit_length()


def one_batch(spark, tables, folder, number, n=6):
    folder.mkdir(exist_ok=True)
    write_archive(folder, folder.name, 100 * int(folder.name[3:]), n)
    files = scan_archives(spark, str(folder))
    St.audit_batch(spark, files, jobs_of(files), ["Crypto"], tables, number, NOW, every=2)


def test_a_late_batch_reads_no_more_history_than_an_early_one(spark, tmp_path, monkeypatch):
    read, tables = [], f"{tmp_path}/tables"

    def places(*args):
        made = read_places(*args)
        read.append(len(made.inputFiles()))
        return made

    read_places = St.read_places
    monkeypatch.setattr(St, "read_places", places)
    for i in range(5):
        one_batch(spark, tables, tmp_path / f"job{i}", i)
    assert read == [0] * 4  # archives of new jobs have no history, whatever the number of batches

    # A lookup by id reads what was merged (four batches are one segment by now) and the batches since.
    every = spark.read.parquet(f"{tables}/flagged").select("id", "job_id", "tweet_id")
    flags = St.stream_flags(spark, tables, 2)
    assert sorted(flags.select(*every.columns).collect()) == sorted(every.collect())
    one = flagged_by_id(flags, every.first().id)
    assert one.count() == 1 and "EqualTo(id" in one._jdf.queryExecution().toString()
    folders = {"/".join(f.split("/tables/")[1].split("/")[:2]) for f in one.inputFiles()}
    assert folders == {"flagged_by_id/0-4", "flagged/batch_id=4"}

    # An archive that comes again meets the posts of its own batch only; a batch that is run again replaces its rows.
    for _ in range(2):
        one_batch(spark, tables, tmp_path / "job2", 5, n=12)
    assert read[4:] == [1, 1]
    posts, flagged, scored = (spark.read.parquet(f"{tables}/{t}") for t in ("posts", "flagged", "scored"))
    assert posts.count() == posts.select("job_id", "tweet_id").distinct().count() == 5 * 5 + 5
    columns = ["job_id", "total", "processed", "calls", "flagged"]
    assert sorted(St.stream_progress(spark, tables, 2).select(*columns).collect()) == sorted(
        jobs.progress_from_tables(posts, flagged, scored).select(*columns).collect())
    state = {short(r.job_id): (r.status, r.total) for r in St.stream_status(spark, tables).collect()}
    assert state == {f"job{i}": ("done", 10 if i == 2 else 5) for i in range(5)}


def test_an_untouched_job_keeps_its_status(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = [f"{folder}/job{i}.js" for i in range(9)]
    known = spark.createDataFrame([(n,) for n in names], "job_id STRING").withColumn(
        "criteria", parse_criteria(F.lit('{"tone": "calm"}')))
    for i in range(3):
        write_archive(folder, f"job{i}", 100 * i)
        files = St.watch_archives(spark, str(folder))
        St.audit_stream(files, known, ["Crypto"], f"{tmp_path}/tables", f"{tmp_path}/checkpoint", clock=lambda: NOW).trigger(
            availableNow=True).start().awaitTermination()
    state = {short(r.job_id): r.status for r in St.stream_status(spark, f"{tmp_path}/tables", known).collect()}
    assert state == {f"job{i}": "done" if i < 3 else "queued" for i in range(9)}


def test_admission_by_bytes_and_moved_files(spark, tmp_path):
    folder, done = tmp_path / "in", tmp_path / "done"
    folder.mkdir()
    write_archive(folder, "large", 0, n=600)
    for i in range(3):
        write_archive(folder, f"small{i}", 1000 * (i + 1), n=2)
    limit = (folder / "small0.js").stat().st_size * 2 + 1
    files = St.watch_archives(spark, str(folder), max_bytes=limit, done=str(done))
    query = St.audit_stream(files, jobs_of, ["Crypto"], f"{tmp_path}/tables", f"{tmp_path}/checkpoint",
                            clock=lambda: NOW).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
    posts = spark.read.parquet(f"{tmp_path}/tables/posts")
    assert len(batches) >= 2 and posts.select("job_id").distinct().count() == 4
    sizes = posts.filter("NOT contains(job_id, 'large')").groupBy("batch_id").agg(F.countDistinct("job_id").alias("n"))
    assert max(r.n for r in sizes.collect()) <= 2  # three small files exceed the limit; the large one is taken all the same
