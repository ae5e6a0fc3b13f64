"""Geometry queries: projection, line centroids, GeoJSON out and back in.

Test geometry from the point table: lon = -77 + embedding[0] and
lat = 38.9 + embedding[1] (degrees around the reference's city); a three-vertex
line per row through (e0, e1), (e2, e3), (e4, e5)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from segstats.operators.spatial import project as pj
from segstats.plans.registry import query
from segstats.session import ensure_checkpoint_dir
from segstats.sources import geojson as gj
from segstats.sources import sinks
from segstats.sources import testdata as td

P = pj.LCC()
C = P.constants


def _lit(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def lcc_sql(lon: str, lat: str) -> tuple[str, str]:
    """SQL twin of ``lcc_forward`` (same constants, same operation order)."""
    e, n = C["e"], C["n"]
    phi = f"(({lat}) * {_lit(pj.DEG)})"
    es = f"({_lit(e)} * sin({phi}))"
    t = f"(tan({_lit(math.pi / 4)} - {phi} / 2) / pow((1.0::DOUBLE - {es}) / (1.0::DOUBLE + {es}), {_lit(e / 2)}))"
    r = f"({_lit(C['aF'])} * pow({t}, {_lit(n)}))"
    theta = f"({_lit(n)} * ((({lon}) - {_lit(P.lon0)}) * {_lit(pj.DEG)}))"
    return (f"({_lit(P.false_e)} + {r} * sin({theta}))", f"({_lit(P.false_n + C['r0'])} - {r} * cos({theta}))")


def lonlat(spark, d):
    e = td.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    (F.lit(-77.0) + F.col("embedding")[0].cast("double")).alias("lon"),
                    (F.lit(38.9) + F.col("embedding")[1].cast("double")).alias("lat"))


_LL = """(SELECT vec_id AS id, -77.0::DOUBLE + CAST(embedding[1] AS DOUBLE) AS lon,
        38.9::DOUBLE + CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)"""
_X, _Y = lcc_sql("lon", "lat")


@query("project_points", sql=f"SELECT id, round({_X}, 6) AS x, round({_Y}, 6) AS y FROM {_LL} t")
def project_points(spark, d):
    """G1: longitude / latitude to projected metres (Lambert conformal conic)."""
    ll = lonlat(spark, d)
    x, y = pj.lcc_forward(F.col("lon"), F.col("lat"))
    return ll.select("id", x.alias("x"), y.alias("y"))


@query("unproject_points", sql=f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_LL} t")
def unproject_points(spark, d):
    """G1 inverse: projected metres back to longitude / latitude (the oracle is the
    original coordinate, so the round trip must close)."""
    ll = lonlat(spark, d)
    x, y = pj.lcc_forward(F.col("lon"), F.col("lat"))
    lon, lat = pj.lcc_inverse(F.col("x"), F.col("y"))
    return ll.select("id", x.alias("x"), y.alias("y")).select("id", lon.alias("lon"), lat.alias("lat"))


def lines(spark, d):
    e = td.table(spark, d, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    return e.select(F.col("vec_id").alias("id"),
                    F.array(F.array(v[0], v[1]), F.array(v[2], v[3]), F.array(v[4], v[5])).alias("coordinates"))


def _seg(a: int, b: int) -> tuple[str, str, str]:
    xa, ya, xb, yb = (f"CAST(embedding[{i}] AS DOUBLE)" for i in (2 * a + 1, 2 * a + 2, 2 * b + 1, 2 * b + 2))
    length = f"sqrt(({xb} - {xa}) * ({xb} - {xa}) + ({yb} - {ya}) * ({yb} - {ya}))"
    return length, f"(({xa} + {xb}) / 2)", f"(({ya} + {yb}) / 2)"


_L1, _MX1, _MY1 = _seg(0, 1)
_L2, _MX2, _MY2 = _seg(1, 2)


@query("line_centroid", sql=f"""
SELECT id, round(CASE WHEN l > 0 THEN sx / l ELSE x0 END, 6) AS cx, round(CASE WHEN l > 0 THEN sy / l ELSE y0 END, 6) AS cy
FROM (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS y0,
             0.0::DOUBLE + {_L1} + {_L2} AS l,
             0.0::DOUBLE + {_L1} * {_MX1} + {_L2} * {_MX2} AS sx,
             0.0::DOUBLE + {_L1} * {_MY1} + {_L2} * {_MY2} AS sy FROM embeddings)
""")
def line_centroid(spark, d):
    """Length-weighted centroid of each polyline."""
    c = pj.line_centroid(F.col("coordinates"))
    return lines(spark, d).select("id", c["cx"].alias("cx"), c["cy"].alias("cy"))


@query("label_geometry", sql=f"""
WITH l AS (SELECT o_custkey AS id, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS csl FROM orders GROUP BY 1)
SELECT e.vec_id AS id, round(l.csl, 6) AS csl, round(CASE WHEN len > 0 THEN sx / len ELSE x0 END, 6) AS cx,
       round(CASE WHEN len > 0 THEN sy / len ELSE y0 END, 6) AS cy
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS y0, 0.0::DOUBLE + {_L1} + {_L2} AS len,
             0.0::DOUBLE + {_L1} * {_MX1} + {_L2} * {_MX2} AS sx, 0.0::DOUBLE + {_L1} * {_MY1} + {_L2} * {_MY2} AS sy
      FROM embeddings) e JOIN l ON e.vec_id = l.id
""")
def label_geometry(spark, d):
    """The label joined with the segments' geometry (centroid of each line)."""
    c = pj.line_centroid(F.col("coordinates"))
    lab = td.labels(spark, d).withColumnRenamed(td.KEY, "id")
    return lines(spark, d).join(lab, "id").select("id", "csl", c["cx"].alias("cx"), c["cy"].alias("cy"))


PROPS = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())])


def geojson_lines_of(spark, d):
    pts = td.points(spark, d).select("id", "value")
    return lines(spark, d).join(pts, "id").select("id", "value", "coordinates")


@query("geojson_features")
def geojson_features(spark, d):
    """One GeoJSON Feature per segment (newline-delimited text rows)."""
    return sinks.geojson_lines(geojson_lines_of(spark, d), "coordinates", ["id", "value"])


@query("geojson_scan")
def geojson_scan(spark, d):
    """A2 + A7: features written as newline-delimited GeoJSON to the shared
    folder and scanned back with an explicit schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/geojson-{uuid.uuid4().hex}"
    sinks.geojson_lines(geojson_lines_of(spark, d), "coordinates", ["id", "value"]).write.text(path)
    return gj.read_features(spark, path, PROPS)
