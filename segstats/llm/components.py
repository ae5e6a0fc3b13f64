"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with one node of its
    component, the same for all. Each round every node moves to its smallest
    neighbour (a partial aggregate) and edges between moved ends remain, so stars
    end in one round and paths halve; rounds end when no edge is left."""
    edges = cut_lineage(edges.filter("a <> b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        moved = to.withColumnRenamed("a", "node")
        if labels is None:
            labels = moved.withColumnRenamed("to", "component")
        else:
            labels = cut_lineage(labels.join(moved.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")))
        left = edges.join(to.withColumnRenamed("to", "x"), "a").join(
            to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = cut_lineage(left.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if edges.isEmpty():
            return labels
