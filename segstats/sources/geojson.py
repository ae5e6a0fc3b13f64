"""GeoJSON sources: newline-delimited features (one feature per line, split across tasks
like any JSON source) and FeatureCollection documents (optionally wrapped as a
JavaScript assignment, as map pages embed them).

A FeatureCollection is split too. The file is read as records that end in a closing brace, so
every task gets the records of its byte range in order. A first pass sums up each range: whether
it ends inside a string and how deep in braces, for both ways it may begin; from these few figures
the driver knows the state at the start of every range. The second pass cuts the
features out; what a range begins or ends in the middle of is put together by its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def feature_schema(properties: T.StructType, geometry: T.StructType = LINE) -> T.StructType:
    return T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("geometry", geometry),
    ])


def read_features(spark: SparkSession, path: str, properties: T.StructType,
                  geometry: T.StructType = LINE) -> DataFrame:
    """Newline-delimited GeoJSON features -> (properties..., geometry)."""
    df = spark.read.schema(feature_schema(properties, geometry)).json(path)
    return df.select("properties.*", F.col("geometry.coordinates").alias("coordinates"))


_TOKEN = re.compile(r'\\.|["{]', re.S)


def _walk(record: str, inside: bool, depth: int, base: int = 1) -> tuple[bool, int, int | None]:
    """State after a record and its closing brace, and where the brace stands that leads from depth
    ``base`` to the next (None without). ``inside``: the record begins in a string."""
    start = None
    for m in _TOKEN.finditer(record):
        if m.group() == '"':
            inside = not inside
        elif m.group() == "{" and not inside:
            if depth == base:
                start = m.start()
            depth += 1
    return inside, depth if inside else depth - 1, start


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): records that end in a closing brace, in order within the byte range at ``start``."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and way to begin (in a string or not): the end, the change of depth and the smallest depth on the way."""
    found: dict = {}
    for file, start, value in _by_range(batches):
        for inside in (False, True):
            now, depth, least = found.get((file, start, inside), (inside, 0, 0))
            now, depth, _ = _walk(value, now, depth)
            found[file, start, inside] = (now, depth, min(least, depth))
    rows = [(*k, *v) for k, v in found.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                     ["file", "start", "inside", "ends", "depth", "least"])


def _states(rows: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(in a string, depth, range where the open feature began) at the start of every range."""
    by, out = {(r["file"], r["start"], r["inside"]): r for r in rows}, {}
    for file in sorted({r["file"] for r in rows}):
        inside, depth, origin = False, 0, -1
        for start in sorted({r["start"] for r in rows if r["file"] == file}):
            out[file, start] = (inside, depth, origin)
            r = by[file, start, inside]
            if depth < 2 or depth + r["least"] < 2:  # a feature that is open at the end began here
                origin = start
            inside, depth = r["ends"], depth + r["depth"]
    return out


def read_feature_collection(spark: SparkSession, path: str, properties: T.StructType,
                            geometry: T.StructType = LINE) -> DataFrame:
    """FeatureCollection documents (or ``var x = {...};``) -> one row per feature. One file gives as many tasks
    as it has splits (``spark.sql.files.maxPartitionBytes``). Members of the collection that are no features are left out."""
    records = _ranges(spark, path)
    # two rows per byte range
    states = _states(records.mapInArrow(_summaries, "file string, start long, inside boolean, ends boolean, depth long, least long").collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, origin, start, text, whole): objects at depth 2, whole or the part of one that lies in this range."""
        at, text, rows = None, [], []

        def flush():
            if at and depth >= 2 and text:
                rows.append((*at[:1], origin, at[1], "".join(text), False))

        for file, start, value in _by_range(batches):
            if at != (file, start):
                flush()
                at, text = (file, start), []
                inside, depth, origin = states[at]
                whole = False
            inside, depth_after, begin = _walk(value, inside, depth)
            if depth < 2:
                if begin is None:  # between features
                    depth = depth_after
                    continue
                text, origin, whole = [value[begin:]], start, True
            else:
                text.append(value)
            text.append("}")
            depth = depth_after
            if depth < 2:
                rows.append((file, origin, start, "".join(text), whole))
                text = []
            if len(rows) >= 1000:
                yield _batch(rows)
                rows.clear()
        flush()
        yield _batch(rows)

    parts = records.mapInArrow(cut, "file string, origin long, start long, text string, whole boolean")
    split = parts.filter("not whole").groupBy("file", "origin").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("t"))
    whole = parts.filter("whole").select("text").unionByName(split.select(F.array_join("t.text", "").alias("text")))
    doc = whole.select(F.from_json("text", feature_schema(properties, geometry)).alias("f")).filter(F.col("f.type") == "Feature")
    return doc.select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "origin", "start", "text", "whole"])
