"""Counters, status, quota, ranks, deduplication and upserts against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postaudit.functions.criteria import DEFAULTS, parse_criteria
from postaudit.functions.paging import quota_reset_at
from postaudit.operators import dedupe, jobs, joins, pending, quota, ranking
from postaudit.plans.audit import History, audit_posts, load_history, run_numbers, save_audit
from postaudit.sources.tables import read_job, write_by_job

T0 = dt.datetime(2024, 1, 1)
TEXTS = ["fine", "you idiot", "kys", "I hate it", "crypto", "ok"]


def make_posts(spark, n=60, jobs_n=4):
    rows = []
    for i in range(n):
        job = 0 if i % 3 == 0 else i % jobs_n
        rows.append((f"job-{job}", str(i), TEXTS[i % len(TEXTS)], T0 + dt.timedelta(minutes=i // 7), i))
    return spark.createDataFrame(rows, "job_id STRING, tweet_id STRING, text STRING, created_at TIMESTAMP, pos BIGINT")


def make_jobs(spark, jobs_n=4):
    text = F.when(F.col("k") % 2 == 0, F.lit('{"tone": "calm"}'))
    return spark.range(jobs_n).withColumnRenamed("id", "k").select(
        F.concat(F.lit("job-"), "k").alias("job_id"), parse_criteria(text).alias("criteria"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_job_splits_hot_jobs_only(spark, how):
    posts, known = make_posts(spark), make_jobs(spark, 3)
    small = joins.join_by_job(posts, known, how)
    large = joins.join_by_job(posts, known, how, hot_posts=12)
    assert "Generate explode" not in small._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in large._jdf.queryExecution().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))
    assert small.count() == (60 if how == "left" else 60 - posts.filter("job_id = 'job-3'").count())


def test_keep_first_on_one_hot_key(spark):
    rows = [("j", "hot", f"t{i}", i) for i in range(500)] + [("j", str(i % 5), f"u{i}", i) for i in range(50)] + [("j", "once", "x", 9)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id STRING, tweet_id STRING, text STRING, pos BIGINT").repartition(7)
    few = {r.tweet_id: (r.text, r.pos) for r in dedupe.keep_first(frame).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = {r.tweet_id: (r.text, r.pos) for r in dedupe.keep_first(frame).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert few == many == {"hot": ("t0", 0), **{str(i): (f"u{i}", i) for i in range(5)}, "once": ("x", 9)}


def test_keep_first_moves_only_rows_that_may_have_copies(spark, monkeypatch):
    rows = [(f"job-{i % 3}", str(i % 4000), f"text {i}", i) for i in range(5000)]
    frame = spark.createDataFrame(rows + [("job-0", None, "no id", 1), ("job-0", None, "no id", 2)],
                                  "job_id STRING, tweet_id STRING, text STRING, pos INT")
    first = {}
    for job, post, text, pos in rows:
        first.setdefault((job, post), (text, pos))
    expected = sorted((*k, *v) for k, v in first.items())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits in (dedupe.FILTER_BITS, 1 << 15, 8):  # a filter that is full costs moves, not rows
            monkeypatch.setattr(dedupe, "FILTER_BITS", bits)
            made = dedupe.keep_first(frame)
            body = made._jdf.queryExecution().executedPlan().toString()
            got = made.collect()
            assert sorted(tuple(r) for r in got if r.tweet_id is not None) == expected
            assert sorted(r.pos for r in got if r.tweet_id is None) == [1, 2]
            moves = [x for x in body.splitlines() if "Exchange" in x and "Broadcast" not in x]
            assert len(moves) == 1 and "SortMergeJoin" not in body
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keep_first_over_files_and_members(spark):
    rows = [("j", "1", f"{p}{m}", i, p, m) for p in ("b", "a") for m in ("y", "x") for i in (0, 1)]
    frame = spark.createDataFrame(rows, "job_id STRING, tweet_id STRING, text STRING, pos BIGINT, path STRING, member STRING")
    assert [(r.path, r.member, r.pos) for r in dedupe.keep_first(frame).collect()] == [("a", "x", 0)]


@pytest.mark.parametrize("close", [1, 40, 10_000])
def test_narrow_and_admit(spark, monkeypatch, close):
    rnd = random.Random(8)
    times = [T0 + dt.timedelta(seconds=rnd.choice([0, 5, 60, 86400]) * rnd.randrange(50)) for _ in range(400)]
    rows = [(t, rnd.randrange(5), f"j{i % 3}", str(i)) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "created_at TIMESTAMP, pos INT, job_id STRING, tweet_id STRING")
    monkeypatch.setattr(ranking, "CLOSE_ROWS", close)
    monkeypatch.setattr(ranking.narrow, "__defaults__", (close,))
    for room in (0, 1, 57, 399, 400, 1000):
        got = {r.tweet_id for r in quota.admit(frame, room).filter("admitted").collect()}
        assert got == {r[3] for r in sorted(rows)[:room]}
    assert quota.admit(frame, 57).count() == 400 and quota.admit(frame.limit(0), 5).count() == 0
    holes = frame.withColumn("created_at", F.when(F.col("pos") > 0, F.col("created_at")))
    order = sorted(holes.collect(), key=lambda r: (r.created_at is not None, r.created_at or T0, r.pos, r.job_id, r.tweet_id))
    for room in (5, 200):
        assert {r.tweet_id for r in quota.admit(holes, room).filter("admitted").collect()} == {r.tweet_id for r in order[:room]}


def test_the_cut_is_a_pushed_down_range(spark, tmp_path):
    frame = spark.range(5000).select((F.lit(T0) + F.make_interval(secs=F.col("id") * 7 % 4001)).alias("created_at"))
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    times = sorted(r[0] for r in stored.collect())
    for descending, order in ((False, times), (True, times[::-1])):
        low, high, before = ranking.narrow(stored, "created_at", descending, 1200, 1210, 100)
        near = stored.filter(ranking.between(stored, "created_at", low, high))
        held = sorted((r[0] for r in near.collect()), reverse=descending)
        assert len(held) <= 100 and held[1199 - before:1210 - before] == order[1199:1210]
        assert "GreaterThanOrEqual(created_at" in near._jdf.queryExecution().executedPlan().toString()
    assert ranking.narrow(stored, "created_at", True, 6000, 6001)[2] == 5000


def test_global_rank(spark):
    values = [(random.Random(i).randrange(20), i) for i in range(1000)]
    frame = spark.createDataFrame(values, "a INT, b INT").repartition(5)
    got = [(r.a, r.b) for r in ranking.global_rank(frame, [F.col("a").desc(), F.col("b").asc()]).orderBy("rank").collect()]
    assert got == sorted(values, key=lambda v: (-v[0], v[1]))
    ranks = sorted(r.rank for r in ranking.global_rank(frame, [F.col("a"), F.col("b")]).collect())
    assert ranks == list(range(1, 1001))


def test_top_per_key(spark):
    values = [("hot" if i % 3 else str(i % 9), i) for i in range(900)]
    frame = spark.createDataFrame(values, "k STRING, v INT")
    got = {(r.k, r.v) for r in ranking.top_per_key(frame, "k", [F.col("v").desc()], 4, spread_by="v", salts=5).collect()}
    expected = set()
    for key in {k for k, _ in values}:
        expected |= {(key, v) for v in sorted((v for k, v in values if k == key), reverse=True)[:4]}
    assert got == expected


@pytest.mark.parametrize("room", [0, 1, 17, 60, 1000])
def test_admission_in_queue_order(spark, room):
    posts = make_posts(spark)
    got = {r.tweet_id for r in quota.admit(posts, room).filter("admitted").collect()}
    order = sorted(posts.collect(), key=lambda r: (r.created_at, r.pos))
    assert got == {r.tweet_id for r in order[:room]}


def test_quota_counts(spark):
    calls = spark.createDataFrame([("j", str(i), T0 + dt.timedelta(hours=5 * i)) for i in range(6)],
                                  "job_id STRING, tweet_id STRING, scored_at TIMESTAMP")
    day = dt.date(2024, 1, 1)
    assert quota.used_on(calls, dt.date(2023, 5, 5)) == 0
    assert quota.used_on(calls, day) == 5
    assert quota.room_left(calls, day, 7) == 2 and quota.room_left(calls, day, 3) == 0
    assert {r.day: r.calls for r in quota.quota_usage(calls).collect()} == {day: 5, dt.date(2024, 1, 2): 1}
    reset = calls.select(quota_reset_at(F.col("scored_at")).alias("r")).first().r
    assert reset == dt.datetime(2024, 1, 2, 0, 1)


@pytest.mark.parametrize("text, expected", [
    (None, None), ("", None), ("{bad", None), ('{"tone": 5} x', None), ('{"professional_check": "yes"}', None),
    ('{"criteria": {"tone": "a", "exclude_threats": true, "forbidden_words": ["x"]}}',
     {"tone": "a", "exclude_threats": True, "forbidden_words": ["x"]}),
    ('{"tone": "b", "other": [1]}', {"tone": "b"}), ("{}", {})])
def test_criteria(spark, text, expected):
    got = spark.createDataFrame([(text,)], "s STRING").select(parse_criteria(F.col("s")).alias("c")).first().c
    if expected is None:
        assert got is None
    else:
        zero = {k: [] if k == "forbidden_words" else "" if k == "tone" else False for k in DEFAULTS}
        assert got.asDict() == {**zero, **expected}


def expected_audit(posts):
    """Flags by plain Python: job-0 and job-2 have criteria and so the filter."""
    flags, filtered = {}, set()
    for r in posts:
        low = r.text.lower()
        own = r.job_id in ("job-0", "job-2")
        if own and ("crypto" in low or "kys" in low):
            flags[r.tweet_id] = "blocked_phrase" if "crypto" in low else "threat"
            filtered.add(r.tweet_id)
        elif any(p in low for p in ("idiot", "kys", "i hate")):
            flags[r.tweet_id] = "llm_scorer"
    return flags, filtered


def test_audit_of_posts(spark):
    posts, known = make_posts(spark), make_jobs(spark)
    audit = audit_posts(posts, known, ["Crypto"], T0)
    flags, filtered = expected_audit(posts.collect())
    assert {r.tweet_id: r.filter_reason for r in audit.flagged.collect()} == flags
    assert audit.scored.count() == 60 - len(filtered) and audit.waiting.count() == 0
    for r in audit.progress.collect():
        mine = [p for p in posts.collect() if p.job_id == r.job_id]
        assert (r.total, r.processed) == (len(mine), len(mine))
        assert r.flagged == sum(p.tweet_id in flags for p in mine)
        assert r.calls == sum(p.tweet_id not in filtered for p in mine)
    assert {r.status for r in audit.status.collect()} == {"done"}


def history(*audits):
    """What the given runs leave for the next."""
    join = lambda name: __import__("functools").reduce(lambda a, b: a.unionByName(b), [getattr(x, name) for x in audits])
    return History(join("posts"), join("flagged"), join("new_scores"), audits[-1].waiting)


def test_audit_pauses_at_the_quota_and_resumes(spark):
    posts, known = make_posts(spark), make_jobs(spark)
    flags, filtered = expected_audit(posts.collect())
    day = dt.datetime(2024, 3, 1, 12)
    first = audit_posts(posts, known, ["Crypto"], day, quota=20)
    assert first.scored.count() == 20 and first.waiting.count() == 60 - len(filtered) - 20
    assert "paused_quota" in {r.status for r in first.status.collect()}
    blocked = audit_posts(posts, known, ["Crypto"], day, before=history(first), quota=20)
    assert blocked.new_scores.count() == 0 and blocked.waiting.count() == first.waiting.count()
    assert blocked.posts.count() == 0 == blocked.flagged.count()
    # The criteria came with the waiting posts, so the jobs need not be known any more.
    second = audit_posts(posts.limit(0), known.limit(0), ["Crypto"], day + dt.timedelta(days=1),
                         before=history(first, blocked), quota=1000)
    assert second.waiting.count() == 0 and second.scored.count() == 60 - len(filtered)
    assert {r.status for r in second.status.collect()} == {"done"}
    found = [r.tweet_id for a in (first, blocked, second) for r in a.flagged.collect()]
    assert sorted(found) == sorted(flags)


def test_second_run_over_new_posts_of_known_jobs(spark):
    posts, known = make_posts(spark), make_jobs(spark)
    first = audit_posts(posts.filter("pos < 25"), known, ["Crypto"], T0)
    second = audit_posts(posts, known, ["Crypto"], T0, before=history(first))
    assert second.posts.count() == 35
    flags, filtered = expected_audit(posts.collect())
    assert sorted(r.tweet_id for a in (first, second) for r in a.flagged.collect()) == sorted(flags)
    for r in second.progress.collect():
        mine = [p for p in posts.collect() if p.job_id == r.job_id]
        assert (r.total, r.processed, r.flagged) == (len(mine), len(mine), sum(p.tweet_id in flags for p in mine))
    assert {r.status for r in second.status.collect()} == {"done"}


def test_unknown_jobs_are_audited(spark):
    posts = make_posts(spark, 6, 1)
    audit = audit_posts(posts, make_jobs(spark).limit(0), ["Crypto"], T0)
    assert {r.tweet_id for r in audit.flagged.collect()} == {"1", "2", "3"}
    assert [(r.job_id, r.status) for r in audit.status.collect()] == [("job-0", "done")]


def test_texts_are_judged_once(spark):
    audit = audit_posts(make_posts(spark), make_jobs(spark), ["Crypto"], T0)
    for frame in (audit.flagged, audit.progress, audit.status):
        assert "crypto" not in frame._jdf.queryExecution().executedPlan().toString().lower()


def test_counters_from_state_and_from_tables_agree(spark):
    posts, known = make_posts(spark), make_jobs(spark)
    audit = audit_posts(posts, known, ["Crypto"], T0, quota=25)
    flags, filtered = expected_audit(posts.collect())
    done = {r.tweet_id for r in audit.scored.collect()}
    rows = [(p.job_id, p.tweet_id not in filtered, p.tweet_id in filtered or p.tweet_id in done, p.tweet_id in flags)
            for p in posts.collect()]
    state = spark.createDataFrame(rows, "job_id STRING, needs_scoring BOOLEAN, processed BOOLEAN, should_flag BOOLEAN")
    columns = ["job_id", "total", "processed", "calls", "flagged"]
    assert sorted(jobs.job_progress(state).select(*columns).collect()) == sorted(
        audit.progress.select(*columns).collect())


def test_job_status_of_each_kind(spark):
    names = ["failed", "paused_quota", "done", "running", "queued"]
    frame = spark.createDataFrame([(n,) for n in names], "job_id STRING")
    counts = spark.createDataFrame([("failed", 1, 1), ("paused_quota", 2, 1), ("done", 2, 2), ("running", 2, 1)],
                                   "job_id STRING, total BIGINT, processed BIGINT")
    broken = spark.createDataFrame([("failed", "why")], "job_id STRING, error STRING")
    waiting = spark.createDataFrame([("paused_quota", False), ("running", True)], "job_id STRING, admitted BOOLEAN")
    rows = jobs.job_status(frame, counts, broken, waiting).collect()
    assert {r.job_id: r.status for r in rows} == {n: n for n in names}
    assert jobs.get_job(frame, "none").count() == 0 and jobs.get_job(frame, "done").count() == 1


def test_upsert_can_be_merged_in_any_split(spark):
    ddl = "id STRING, file_id STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP, n BIGINT"
    rows = [(f"j{i % 3}", f"f{i}", f"s{i}", T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=(i * 7) % 20), i)
            for i in range(20)]
    whole = spark.createDataFrame(rows, ddl)
    seq = F.struct("updated_at", "n")
    expected = {}
    for key in ("j0", "j1", "j2"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], r[5]))
        expected[key] = (mine[0][1], mine[-1][2], mine[0][3], mine[-1][4])
    part = jobs.job_upsert(whole.filter("n < 11"))
    merged = jobs.job_upsert(part.unionByName(whole.filter("n >= 11").withColumn("first_seq", seq)))
    for frame in (jobs.job_upsert(whole), merged):
        assert {r.id: (r.file_id, r.status, r.created_at, r.updated_at) for r in frame.collect()} == expected


def test_pending_marks(spark):
    posts = make_posts(spark, 6).withColumn("route", F.when(F.col("pos") == 2, "flagged_now").otherwise("needs_scoring"))
    scored = posts.filter("pos IN (0, 1)").select("job_id", "tweet_id")
    state = pending.mark_processed(posts, scored.unionByName(scored))
    assert state.count() == 6
    assert {r.pos for r in pending.pending(state).collect()} == {3, 4, 5}
    assert [r.pos for r in pending.pending_top(state, 2).collect()] == [3, 4]
    assert {r.pos for r in pending.resume_pending(posts, scored).collect()} == {2, 3, 4, 5}


def test_tables_by_job(spark, tmp_path):
    posts = make_posts(spark)
    write_by_job(posts, str(tmp_path / "t"), buckets=8)
    assert sorted(read_job(spark, str(tmp_path / "t")).select(*posts.columns).collect()) == sorted(posts.collect())
    one = read_job(spark, str(tmp_path / "t"), "job-0", buckets=8)
    assert one.count() == posts.filter("job_id = 'job-0'").count()
    assert "PartitionFilters: [isnotnull(job_bucket" in one._jdf.queryExecution().toString()


def test_saved_runs_make_one_row_per_post_and_flag(spark, tmp_path):
    posts, known, path = make_posts(spark), make_jobs(spark), str(tmp_path)
    audit = audit_posts(posts.filter("pos < 30"), known, ["Crypto"], T0)
    for _ in range(2):
        save_audit(audit, path, "a")
    for _ in range(2):
        again = audit_posts(posts, known, ["Crypto"], T0, before=load_history(spark, path, "b"))
        save_audit(again, path, "b")
    for table, n in (("posts", 60), ("flagged", len(expected_audit(posts.collect())[0])), ("flagged_by_id", None)):
        rows = spark.read.parquet(f"{path}/{table}")
        assert rows.count() == rows.select("tweet_id").distinct().count() == (n or rows.count())
    assert spark.read.parquet(f"{path}/jobs/run=a").count() == 4
    assert {r.total for r in spark.read.parquet(f"{path}/jobs/run=b").filter("job_id = 'job-0'").collect()} == {30}


def test_runs_are_ordered_by_number_not_by_name(spark, tmp_path):
    """run-10 sorts before run-9; its history has run-9 nevertheless, and no post is stored or flagged twice."""
    path, known, posts = str(tmp_path), make_jobs(spark), make_posts(spark)
    with pytest.raises(ValueError, match="no run was saved"):
        load_history(spark, path, "run-9")
    save_audit(audit_posts(posts.filter("pos < 30"), known, ["Crypto"], T0, quota=3), path, "run-9")
    save_audit(audit_posts(posts, known, ["Crypto"], T0, before=load_history(spark, path, "run-10")), path, "run-10")
    assert run_numbers(spark, path) == {"run-9": 1, "run-10": 2}
    assert load_history(spark, path, "run-10").posts.count() == 30
    assert load_history(spark, path, "2024").posts.count() == 60
    for table in ("posts", "flagged"):
        rows = spark.read.parquet(f"{path}/{table}")
        assert rows.count() == rows.select("tweet_id").distinct().count()
    assert spark.read.parquet(f"{path}/waiting").filter("run = 'run-10'").count() == 0


def test_hot_bucket_is_split_on_write(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        rows = spark.range(20000, numPartitions=8).select(
            F.lit("job-0").alias("job_id"), F.col("id").cast("string").alias("tweet_id"), F.md5(F.col("id").cast("string")))
        write_by_job(rows, str(tmp_path / "t"))
        assert len(list((tmp_path / "t").rglob("part-*.parquet"))) > 4
        assert read_job(spark, str(tmp_path / "t"), "job-0").count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
