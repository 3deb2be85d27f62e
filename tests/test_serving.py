"""Lists, pages, counts and exports of the flag table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postaudit.functions.paging import page_bounds, page_offset
from postaudit.operators import ranking, serving

T0 = dt.datetime(2024, 1, 1)


def flags(spark, per_job):
    rows = [(f"{job}-{i}", f"{i}", job, T0 + dt.timedelta(minutes=i // 2), f"https://x/{job}/{i}" if i != 1 else "")
            for job, n in per_job.items() for i in range(n)]
    return spark.createDataFrame(rows, "id STRING, tweet_id STRING, job_id STRING, flagged_at TIMESTAMP, url STRING")


@pytest.mark.parametrize("asked, got", [
    ((0, 10), (1, 10)), ((-3, 0), (1, 20)), ((2, 500), (2, 100)), ((None, None), (1, 20)), ((7, 100), (7, 100))])
def test_page_bounds(asked, got):
    assert page_bounds(*asked) == got


def test_list_newest_first(spark):
    table = flags(spark, {"a": 5, "b": 3})
    ids = [r.id for r in serving.flagged_list(table, "a").collect()]
    assert ids == ["a-4", "a-2", "a-3", "a-0", "a-1"]
    assert serving.flagged_list(table).count() == 8 and serving.flagged_list(table, "zz").count() == 0


def test_pages_are_disjoint_and_whole(spark, monkeypatch):
    table = flags(spark, {"a": 10, "b": 2})
    shallow = [[r.id for r in serving.flagged_page(table, "a", p, 5).collect()] for p in (1, 2, 3)]
    assert [len(p) for p in shallow] == [5, 5, 0] and len(set(shallow[0] + shallow[1])) == 10
    monkeypatch.setattr(ranking.narrow, "__defaults__", (1,))
    deep = [[r.id for r in serving.flagged_page(table, "a", p, 5).collect()] for p in (1, 2, 3)]
    assert deep == shallow
    meta = serving.page_meta(table, "a", 2, 4).first()
    assert (meta.page, meta.page_size, meta.total, meta.total_pages) == (2, 4, 10, 3)
    assert page_offset(3, 20) == 40


def test_counts(spark):
    table = flags(spark, {"a": 3, "b": 2})
    assert {r.job_id: r.n for r in serving.flagged_count_rollup(table).collect()} == {"a": 3, "b": 2, None: 5}
    assert [r.n for r in serving.flagged_count(table, "a").collect()] == [3]
    assert [tuple(r) for r in serving.flagged_count(table, "none").collect()] == [("none", 0)]
    assert serving.flagged_by_id(table, "a-1").count() == 1 and serving.flagged_by_id(table, "q").count() == 0


def test_exports(spark, tmp_path):
    table = flags(spark, {"a": 6, "b": 3})
    urls = serving.export_urls(table, "a")
    assert sorted(r.url for r in urls.collect()) == sorted(f"https://x/a/{i}" for i in (0, 2, 3, 4, 5))
    assert serving.export_urls(table).count() == 7 and serving.export_urls(table, "no").count() == 0
    # The limit counts rows before empty URLs are dropped.
    assert serving.export_urls(table, "a", limit=6).count() == 5
    serving.write_url_lines(urls, str(tmp_path / "csv"))
    lines = sorted(line for f in (tmp_path / "csv").glob("part-*") for line in f.read_text().splitlines())
    assert lines == sorted(f"https://x/a/{i}" for i in (0, 2, 3, 4, 5))
    one = serving.export_json(table, "a", limit=4).first()
    assert json.loads(one.payload) == {"urls": [f"https://x/a/{i}" for i in (4, 5, 2, 3)], "count": 4, "job_id": "a"}
    both = {r.job_id: json.loads(r.payload) for r in serving.export_json_per_job(table, 2).collect()}
    assert both["b"]["urls"] == ["https://x/b/2", "https://x/b/0"]
    assert both["a"]["urls"] == ["https://x/a/4", "https://x/a/5"]
    parts = [json.loads(r.payload)["urls"] for r in serving.export_json_per_job(table, part_urls=2).collect()]
    assert len(parts) > 2 and sorted(sum(parts, [])) == sorted(r.url for r in serving.export_urls(table).collect())
    everything = serving.export_json(table).first()
    assert (everything.job_id, everything.count) == ("", everything["count"]) or everything["count"] == 7


@pytest.mark.parametrize("moments", [1, 3, 400])
def test_parts_one_after_the_other_are_the_whole_list(spark, moments):
    """Large jobs among small ones, all flags of a run at one moment or at many."""
    flags = spark.range(1500).select(
        F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "other").otherwise(
            F.concat(F.lit("s"), F.col("id") % 9)).alias("job_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") % moments)).alias("flagged_at"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    whole = {}
    for r in flags.orderBy(F.desc("flagged_at"), "id").collect():
        whole.setdefault(r.job_id, []).append(r.url)
    rows = serving.export_json_per_job(flags, part_urls=100).orderBy("job_id", "part").collect()
    got, parts = {}, {}
    for r in rows:
        body = json.loads(r.payload)
        assert r["count"] == body["count"] == len(body["urls"]) <= 200 and body["job_id"] == r.job_id
        got.setdefault(r.job_id, []).extend(body["urls"])
        parts.setdefault(r.job_id, []).append(r.part)
    assert got == whole
    assert len(parts["big"]) >= 8 and len(parts["other"]) >= 2 and all(p == [0] for j, p in parts.items() if j[0] == "s")
