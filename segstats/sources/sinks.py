"""Sinks: partitioned feature matrices, catalogues, GeoJSON layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrices(df: DataFrame, path: str, partition_cols=("total", "years"), mode: str = "overwrite") -> None:
    """One matrix per combination as hive-style partitions."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def write_catalogue(catalogue: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature catalogue (feature_type, column, pos) as parquet (A3)."""
    catalogue.write.mode(mode).parquet(path)


def geojson_lines(df: DataFrame, geometry_col: str, property_cols: list[str],
                  geometry_type: str = "LineString") -> DataFrame:
    """One GeoJSON Feature per row as a JSON string column ``value``.
    ``write.text`` of the result gives newline-delimited GeoJSON features."""
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(c) for c in property_cols]).alias("properties"),
        F.struct(F.lit(geometry_type).alias("type"), F.col(geometry_col).alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feat).alias("value"))
