"""Run-result files: many-file scans with tags taken from the paths, and
split tables persisted once per seed and reloaded afterwards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.session import path_exists


def scan_with_path_tags(spark: SparkSession, pattern: str, tags: dict[str, str], fmt: str = "csv",
                        schema=None, **options) -> DataFrame:
    """Read every file matching ``pattern`` in one distributed scan and add a
    column per tag, extracted from the file path by a regular expression with
    one group (e.g. {"seed": r"seed=(\\d+)"}). Replaces per-file loops."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(pattern).withColumn("__path", F.col("_metadata.file_path"))
    for name, rx in tags.items():
        re.compile(rx)
        df = df.withColumn(name, F.regexp_extract("__path", rx, 1))
    return df.drop("__path")


def persisted_split(spark: SparkSession, path: str, build) -> DataFrame:
    """Return the split table stored at ``path``; build and store it first
    when it does not exist yet (``build()`` -> DataFrame). Reruns therefore
    reuse the same train / test ids."""
    if not path_exists(spark, path):
        build().write.mode("error").parquet(path)
    return spark.read.parquet(path)
