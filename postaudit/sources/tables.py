"""The audit's own tables on shared storage: posts, flags, scores as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def job_bucket(job_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def write_by_job(df: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Write rows under a bounded number of job buckets.

    Jobs are too many for a folder each. Rebalancing splits the bucket of a large job into tasks
    of the advisory partition size and joins small ones; rows are sorted by job so that Parquet
    statistics skip the row groups of other jobs.
    """
    (df.withColumn("job_bucket", job_bucket(F.col("job_id"), buckets))
     .hint("rebalance", F.col("job_bucket"))
     .sortWithinPartitions("job_bucket", "job_id")
     .write.mode(mode).partitionBy("job_bucket").parquet(path))


def write_by_id(flagged: DataFrame, path: str, mode: str = "append") -> None:
    """Write flags in ranges of their id, each file sorted, so a lookup by id reads one row group of one file."""
    (flagged.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode)
     .option("parquet.block.size", 16 << 20).parquet(path))


def read_job(spark: SparkSession, path: str, job_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table, or one job of it: only its bucket is listed and read."""
    table = spark.read.parquet(path)
    if job_id:
        bucket = job_bucket(F.lit(job_id), buckets)
        table = table.filter((F.col("job_bucket") == bucket) & (F.col("job_id") == job_id))
    return table.drop("job_bucket")
