"""Corpus pipeline: five operators of ``segstats.llm`` over ``documents``, one after the other.

Each stage works on everything its predecessor kept; its result is written as
parquet and read again, and the table before it is deleted. All but the last return the
columns of ``documents``.

Defined results: null texts and texts without a letter are rejected by language ID if there is a
model; without labelled documents nothing is rejected. Null ids are ids like others. Of
rows equal in text one stays (near copies), whatever their ids. Rows that the mix takes more than once
come out as often, in one shard as far as their law allows; a source may lose rows only to its target.
Extra columns, whatever their names, pass through every stage but the last, which
returns its own columns. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from segstats.llm import decontaminate, group_join, langid, mixing, sharding
from segstats.session import delete, drop_intermediates, ensure_checkpoint_dir, intermediates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language is rejected go. Learns from the labelled
    documents of this stage's input that are not held out."""
    return langid.keep_identified(docs, langid.fit(langid.train_split(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies (five words, 0.8) stays."""
    return group_join.keep_one(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each row as often as the mix takes it."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: 16 shards of equal row counts, linked documents together."""
    return sharding.shard_documents(docs, shards=16)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

# language models and similarity components have no SQL form; tests/llm checks run() by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    read = None
    for i, (name, stage) in enumerate(STAGES):
        before = intermediates()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        drop_intermediates(spark, since=before)  # the stage's own tables
        if read:
            delete(spark, read)
        read = f"{base}/{i}-{name}"
        docs = spark.read.parquet(read)
    return docs
