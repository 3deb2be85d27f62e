"""Session settings the operators rely on, and the one way they keep interim results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postaudit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `conf` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # A retried or speculative attempt must not call a paid model twice.
        "spark.speculation": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="postaudit-")


@cache
def _run_id(session: SparkSession) -> str:
    return uuid.uuid4().hex


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that driver and executors share: `folder`, else the session's spark.checkpoint.dir.

    Only a session within one process may do without; anywhere else each executor would write to a disk
    that the others can't read, so that is an error.
    """
    found = folder or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def interim_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Where this session keeps its interim tables; `clear_interim` removes it."""
    return f"{shared_dir(spark, folder)}/postaudit/{_run_id(spark)}"


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `df` to the shared folder once and go on from the written table.

    Used where rows must not change between two readings (ranks) or must not be computed twice
    (unzip, model calls). The table survives the loss of executors, and later steps read only
    the columns they need of it. `clear_interim` removes what a session has written so.
    """
    spark = df.sparkSession
    path = f"{interim_dir(spark, folder)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes an action's shuffle files as the action ends, not when the driver collects garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and that nothing still to be run reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clear_interim(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the session's interim tables, once nothing that was made from them is still to be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(interim_dir(spark, folder))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
