"""Spark session helpers.

Cluster runs take their settings from the submitting environment; these
defaults only fill what is unset, so a cluster's ``spark.checkpoint.dir``,
shuffle width and memory sizes always win.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, monotonically_increasing_id

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcasts are decided explicitly (see segstats.functions.broadcast_if_small);
    # keep Catalyst's automatic threshold modest so it never ships a growing side.
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "segstats") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SEGSTATS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local master (tests) gets a
    private scratch folder when it is unset; elsewhere that is an error, as each
    machine would write to its own disk."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="segstats-ckpt-")
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    return the re-read frame: the plan runs once, the result survives executor
    loss (unlike a local checkpoint) and the lineage is cut. An RDD checkpoint
    would compute the plan twice (once to count, once to write)."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/segstats-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    if not _INTERMEDIATE:
        atexit.register(_drop_at_exit, df.sparkSession)
    _INTERMEDIATE.append(path)
    return df.sparkSession.read.parquet(path)


SMALL_ROWS = 1000


def small_or_written(df: DataFrame) -> DataFrame:
    """A grouped result that is expected to be a handful of rows: at most ``SMALL_ROWS`` rows are read and
    broadcast as they are (no table is written for them); a larger one becomes a written table
    whose measured size decides how it is joined."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    return broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= SMALL_ROWS else cut_lineage(df)


TASK_ROWS = 500_000


def dealt(df: DataFrame, times: int = 1, rows: int | None = None) -> DataFrame:
    """``df`` dealt to tasks of at most about ``rows`` (``TASK_ROWS``) rows once every row has been spelled out ``times`` times; a
    smaller one stays as it is. Rows go by their number, so that no frequent value gathers in a task."""
    tasks = -(-df.count() * times // (rows or TASK_ROWS))
    return df if tasks <= 1 else df.withColumn("__no", monotonically_increasing_id()).repartition(tasks, "__no").drop("__no")


_INTERMEDIATE: list[str] = []


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist in whatever store Spark reads it from?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def intermediates() -> int:
    """How many tables ``cut_lineage`` has written and nobody has deleted."""
    return len(_INTERMEDIATE)


def drop_intermediates(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables ``cut_lineage`` wrote (those after the first ``since``) once
    no frame built on them is used any more; returns their number."""
    n = len(_INTERMEDIATE) - since
    while len(_INTERMEDIATE) > since:
        delete(spark, _INTERMEDIATE.pop())
    return n


def _drop_at_exit(spark: SparkSession) -> None:
    if spark._jsc is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop_intermediates(spark)
