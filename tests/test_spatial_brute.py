"""Neighbour graphs, G* and projection against brute force on hand-made points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators.spatial import gstar as gs
from segstats.operators.spatial import moran as mo
from segstats.operators.spatial import project as pj
from segstats.operators.spatial import weights as wt


def cloud(n=220, seed=3):
    rng = random.Random(seed)
    pts = [(i, rng.gauss(0, 1) * (0.05 if i % 3 else 5), rng.gauss(0, 1) * (0.05 if i % 3 else 5)) for i in range(n)]
    pts += [(n + i, 0.25, 0.5) for i in range(8)]  # one place
    pts += [(n + 20 + i, float(i), 0.0) for i in range(6)]  # equal distances
    pts.append((n + 50, 400.0, -300.0))  # an outlier
    return [(*p, float((p[0] * 7) % 11)) for p in pts]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(cloud(), "id long, x double, y double, value double").cache()


def dist(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def test_knn_all_k(points):
    rows = cloud()
    got = {}
    for r in wt.knn_family(points, list(range(1, 11))).collect():
        got.setdefault((r["param"], r["src"]), set()).add(r["dst"])
    for a in rows:
        order = sorted((dist(a, b), b[0]) for b in rows if b[0] != a[0])
        for k in range(1, 11):
            assert got[k, a[0]] == {i for _, i in order[:k]}


def test_knn_on_dense_grid(points):
    """Small bounds force dense cells to be split and finer grids to be used."""
    a = sorted(map(tuple, wt.knn(points, 4).select("src", "dst", "rank").collect()))
    b = sorted(map(tuple, wt.knn(points, 4, hot_rows=7, dense_rows=10).select("src", "dst", "rank").collect()))
    assert a == b


@pytest.mark.parametrize("hot", [5, 20_000])
def test_bands(points, hot):
    rows = cloud()
    for t in (0.02, 0.05, 0.1, 0.5, 1.0, 5.0, 20.0):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= t * t}
        e = [(r["src"], r["dst"]) for r in wt.distance_band(points, t, hot_rows=hot).collect()]
        assert len(e) == len(set(e)) and set(e) == want


def test_gstar(points):
    rows = cloud()
    v = np.array([r[3] for r in rows])
    n, mean, s = len(v), v.mean(), v.std()
    e = wt.distance_band(points, 0.3)
    got = {r["id"]: r for r in gs.local_gstar(points, e.withColumn("param", F.lit(0.3)), "value").collect()}
    for i, a in enumerate(rows):
        w = np.array([1.0 if (j == i or dist(a, b) <= 0.3) else 0.0 for j, b in enumerate(rows)])
        z = (w @ v - mean * w.sum()) / (s * math.sqrt((n * (w * w).sum() - w.sum() ** 2) / (n - 1)))
        zs = [c for c in got[a[0]].asDict() if c.lower() in ("zs", "z")]
        assert got[a[0]][zs[0]] == pytest.approx(z, rel=1e-6, abs=1e-6)


def test_moran_value(points):
    rows = cloud()
    e = wt.distance_band(points, 0.5).withColumn("param", F.lit(0.5))
    v = np.array([r[3] for r in rows])
    z = v - v.mean()
    num = s0 = 0.0
    for i, a in enumerate(rows):
        nb = [j for j, b in enumerate(rows) if j != i and dist(a, b) <= 0.5]
        num += z[i] * sum(z[j] for j in nb) / len(nb) if nb else 0.0
        s0 += 1.0 if nb else 0.0
    want = len(v) / s0 * num / (z @ z)
    assert mo.moran(points, e, ["value"]).first()["I"] == pytest.approx(want, rel=1e-9)


def test_projection_round_trip(spark):
    pts = spark.createDataFrame([(float(-80 + i * 0.7), float(36 + j * 0.9)) for i in range(9) for j in range(7)], "lon double, lat double")
    x, y = pj.lcc_forward(F.col("lon"), F.col("lat"))
    lon, lat = pj.lcc_inverse(F.col("px"), F.col("py"))
    for r in pts.withColumns({"px": x, "py": y}).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-9) and r["b"] == pytest.approx(r["lat"], abs=1e-9)
