"""Incremental ingest of experiment run results with Structured Streaming.

Result files land in a folder as runs finish; an availableNow (or periodic)
file-stream query appends only the runs whose key is not in the result table
yet. The table is partitioned by a hash of the key, and a batch reads only the
partitions that its own keys fall into, so a small batch stays cheap however long the
table has grown. So a resumed or repeated experiment never duplicates rows (the
reference's resume-from-earlier-results behaviour). The checkpoint location
makes the ingest exactly-once across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segstats.session import path_exists


BUCKET = "key_bucket"


def key_bucket(keys: list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int").alias(BUCKET)


def known_keys(spark: SparkSession, table_path: str, keys: list[str], touched: list[int]) -> DataFrame | None:
    """Keys of the table in the ``touched`` buckets, None only where the table does not
    exist yet (any other failure stops the batch). The filter prunes partitions."""
    if not path_exists(spark, table_path):
        return None
    return spark.read.parquet(table_path).filter(F.col(BUCKET).isin(touched)).select(*keys, BUCKET).distinct()


def read_runs(spark: SparkSession, table_path: str) -> DataFrame:
    """The result table without its partition column."""
    return spark.read.parquet(table_path).drop(BUCKET)


def ingest_runs(spark: SparkSession, source_dir: str, schema: StructType, table_path: str, checkpoint: str,
                keys: list[str], fmt: str = "parquet", once: bool = True, buckets: int = 256):
    """Start (and with ``once`` wait for) the stream from ``source_dir`` into
    the parquet table at ``table_path``, which has ``buckets`` partitions by the hash of
    ``keys``. Each micro-batch is deduplicated on ``keys`` within itself and against the
    partitions it touches (left anti join) before the append."""

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        new = batch.dropDuplicates(keys).withColumn(BUCKET, key_bucket(keys, buckets))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        have = known_keys(batch.sparkSession, table_path, keys, touched)
        if have is not None:
            same = [new[c].eqNullSafe(have[c]) for c in [BUCKET, *keys]]
            new = new.join(have, same, "left_anti")
        new.withColumn("ingest_epoch", F.lit(epoch_id)).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(table_path)

    stream = spark.readStream.format(fmt).schema(schema).load(source_dir)
    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    q = writer.start()
    if once:
        q.awaitTermination()
    return q
