"""Reading the flag table: lists, pages, counts, lookups and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postaudit import schema as S
from postaudit.functions.paging import page_bounds, page_offset, total_pages
from postaudit.operators.ranking import between, global_rank, narrow, top_per_key
from postaudit.session import materialise

# URLs of one JSON payload, about; a longer export comes in several.
PART_URLS = 10_000
BROADCAST_JOBS = 100_000
"""Job names that are sent to every task at most."""


def _newest_first():
    return [F.col("flagged_at").desc(), F.col("id").asc()]


def of_job(flagged: DataFrame, job_id: str | None = None) -> DataFrame:
    return flagged.filter(F.col("job_id") == job_id) if job_id else flagged


def flagged_list(flagged: DataFrame, job_id: str | None = None) -> DataFrame:
    return of_job(flagged, job_id).orderBy(*_newest_first())


def flagged_page(flagged: DataFrame, job_id: str | None = None, page: int | None = 1,
                 size: int | None = S.PAGE_SIZE_DEFAULT) -> DataFrame:
    page, size = page_bounds(page, size)
    start = page_offset(page, size)
    rows = of_job(flagged, job_id)
    low, high, before = narrow(rows, "flagged_at", True, start + 1, start + size)
    near = rows.filter(between(rows, "flagged_at", low, high))
    if low < high:
        return near.orderBy(*_newest_first()).offset(start - before).limit(size)
    # One moment may hold any number of flags.
    ranked = global_rank(near, _newest_first(), "_rank")
    return (ranked.filter(F.col("_rank").between(start - before + 1, start - before + size)).drop("_rank")
            .orderBy(*_newest_first()))


def flagged_by_id(flagged: DataFrame, flag_id: str) -> DataFrame:
    return flagged.filter(F.col("id") == flag_id)


def flagged_count(flagged: DataFrame, job_id: str | None = None) -> DataFrame:
    """Flags of each job that has any, or the one number of `job_id`, which may be 0."""
    n = F.count(F.lit(1)).alias("n")
    if job_id:
        return of_job(flagged, job_id).agg(n).select(F.lit(job_id).alias("job_id"), "n")
    return flagged.groupBy("job_id").agg(n)


def flagged_count_rollup(flagged: DataFrame) -> DataFrame:
    """Counts per job and, under a NULL job, over all."""
    return flagged.rollup("job_id").agg(F.count(F.lit(1)).alias("n"))


def page_meta(flagged: DataFrame, job_id: str | None = None, page: int | None = 1,
              size: int | None = S.PAGE_SIZE_DEFAULT) -> DataFrame:
    page, size = page_bounds(page, size)
    return of_job(flagged, job_id).agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total",
        total_pages(F.col("total"), size).alias("total_pages"))


def export_urls(flagged: DataFrame, job_id: str | None = None, limit: int | None = None) -> DataFrame:
    """URLs of all flags, or of the newest `limit`; empty URLs are dropped after the limit, as part of it."""
    rows = of_job(flagged, job_id).select("flagged_at", "id", "url")
    if limit is not None:
        rows = rows.orderBy(*_newest_first()).limit(limit)
    return rows.filter(F.col("url") != "").select("url")


def write_url_lines(urls: DataFrame, path: str, mode: str = "error") -> None:
    """One bare URL per line, no header and no quotes."""
    urls.select("url").write.mode(mode).text(path)


def _payload(rows: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.when(F.col("url") != "", F.struct(
        (-F.unix_micros(F.col("flagged_at").cast("timestamp"))).alias("age"), "id", "url"))))
    urls = F.transform(listed, lambda r: r["url"])
    rows = rows.groupBy("job_id", "part").agg(urls.alias("urls")).withColumn("count", F.size("urls").cast("bigint"))
    return rows.select("job_id", "part", "count", F.to_json(F.struct("urls", "count", "job_id")).alias("payload"))


def export_json(flagged: DataFrame, job_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Payloads {urls, count, job_id} of one job, or of all jobs together under an empty job_id."""
    rows = of_job(flagged, job_id).withColumn("job_id", F.lit(job_id or ""))
    return export_json_per_job(rows, limit)


def export_json_per_job(flagged: DataFrame, limit: int | None = None, part_urls: int = PART_URLS) -> DataFrame:
    """Payloads of each job: job_id, part, count, payload; all its flags, or its newest `limit`.

    Parts are consecutive stretches of the newest-first order, about `part_urls` flags each, so a job's parts one after
    the other are its whole list, and no payload grows with the job.
    """
    rows = flagged.select("job_id", "flagged_at", "id", "url")
    if limit is not None:
        rows = top_per_key(rows, "job_id", _newest_first(), limit, spread_by="id")
    large = materialise(rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_urls))
    if large.isEmpty():
        return _payload(rows.withColumn("part", F.lit(0)))
    return _payload(_in_stretches(rows, large, part_urls))


def _in_stretches(rows: DataFrame, large: DataFrame, part_urls: int) -> DataFrame:
    """`rows` with `part`, the stretch of their job's newest-first order that they lie in; 0 for all jobs but `large`.

    A large job's flags are counted by moment and, within a moment, by as many leading characters of the id as make
    its slices smaller than a part; one running sum over these counts cuts the job. Only the counts, far fewer than flags, are sorted.
    """
    parts = F.broadcast if large.count() <= BROADCAST_JOBS else (lambda df: df)
    kept = rows.join(parts(large.select("job_id")), "job_id", "left_anti").withColumn("part", F.lit(0))
    own = rows.join(parts(large.select("job_id")), "job_id", "left_semi")
    moments = own.groupBy("job_id", "flagged_at").agg(F.count(F.lit(1)).alias("n"))
    depth = F.greatest(F.ceil(F.log(16.0, F.col("n") * 8 / part_urls)), F.lit(0)).cast("int").alias("depth")
    depths = materialise(moments.select("job_id", "flagged_at", depth))
    sliced = own.join(depths, ["job_id", "flagged_at"]).withColumn("head", F.expr("substring(id, 1, depth)")).drop("depth")
    counts = sliced.groupBy("job_id", "flagged_at", "head").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("job_id").orderBy(F.desc("flagged_at"), "head").rowsBetween(Window.unboundedPreceding, -1)
    cuts = materialise(counts.select("job_id", "flagged_at", "head", F.floor(
        F.coalesce(F.sum("n").over(before), F.lit(0)) / part_urls).cast("int").alias("part")))
    return kept.unionByName(sliced.join(cuts, ["job_id", "flagged_at", "head"]).drop("head").select(*rows.columns, "part"))
