"""SparkSession helpers.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``.  Only a local session (tests, the bench) gets a folder
of its own where the setting is absent; on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of an execution as soon as it has ended.
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clauseflow") -> SparkSession:
    """Return the active session, or build a local one tuned for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLAUSEFLOW_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder.  Where none is set, a local
    session gets a folder of its own; on a cluster that is an error, as the
    executors would not see it."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="clauseflow-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Executions begun in this block delete their shuffle files when they end.

    For writes of intermediate tables: later steps read the table, so the files
    behind it would only hold disk until the driver collects their references."""
    before = spark.conf.get(_CLEANUP_KEY)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and its path.

    Cuts the lineage with one job; a lost executor costs a re-read.  Unlike a
    checkpoint, a later reader takes only the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_written(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sort_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` by shuffle and sort, for two sides that grow with
    the input.  Spark takes the compressed files of a written table for its size, so
    millions of short rows pass as small and would be collected in the driver to be
    broadcast."""
    return left.join(right.hint("merge"), on, how)


def group_join(left: DataFrame, groups: DataFrame, on, few: int = 10_000) -> DataFrame:
    """Inner join with one row a group: broadcast for a few groups, whose rows would
    otherwise meet in as few tasks, else by sorting."""
    if groups.limit(few + 1).count() <= few:
        return left.join(F.broadcast(groups), on)
    return sort_join(left, groups, on)


def broadcast_if_small(df, max_rows: int = 1_000_000):
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows;
    otherwise leave the join to a shuffle (or to AQE's runtime size check)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
