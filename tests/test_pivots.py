"""Nearest neighbours over many columns against brute force, and the number of candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators import sampling as sp
from segstats.operators.spatial import pivots as pv
from segstats.operators.spatial import weights as wt

DIMS = [f"x{i}" for i in range(20)]


def clustered(seed=1, n=1500, clusters=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 20)) * 5
    own = rng.integers(0, clusters, n)
    x = centre[own] + rng.normal(size=(n, 20)) * 0.2
    x[:30] = x[30:60]  # equal points
    x[60:64] = 100 + rng.normal(size=(4, 20))  # far from all others
    return x, np.where(rng.random(n) < 0.7, "big", "small")


def frame(spark, x, g):
    rows = [(i, c, *map(float, v)) for i, (v, c) in enumerate(zip(x, g))]
    return spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{c} double" for c in DIMS[:x.shape[1]])).repartition(4)


def brute(x, g, k):
    out = {}
    for c in set(g):
        ids = np.flatnonzero(g == c)
        d = np.sqrt(((x[ids, None] - x[None, ids]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for a, row in zip(ids, d):
            order = np.lexsort((ids, row))[:min(k, len(ids) - 1)]
            out.update({(int(a), r + 1): (int(ids[j]), row[j]) for r, j in enumerate(order)})
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_over_twenty_columns(spark, k):
    x, g = clustered()
    got = {(r.src, r["rank"]): (r.dst, r.d) for r in wt.knn(frame(spark, x, g), k, "id", "x0", "x1", dims=DIMS, by=["g"]).collect()}
    want = brute(x, g, k)
    assert set(got) == set(want)
    assert all(got[key][1] == pytest.approx(want[key][1], abs=1e-9) for key in want)
    assert sum(got[key][0] != want[key][0] for key in want) == 0


def test_uniform_points_and_hot_cells(spark):
    rng = np.random.default_rng(2)
    x, g = rng.random((300, 3)), np.array(["a"] * 297 + ["b"] * 3)
    got = {(r.src, r["rank"]): r.dst for r in wt.knn(frame(spark, x, g), 4, "id", "x0", "x1", dims=DIMS[:3], by=["g"], hot_rows=5).collect()}
    assert got == {key: v[0] for key, v in brute(x, g, 4).items()}


def test_few_candidates(spark, monkeypatch):
    """What is compared over all columns is a small part of all pairs."""
    x, g = clustered()
    pairs, real = [], pv._compared
    monkeypatch.setattr(pv, "_compared", lambda ask, points, *a: pairs.append(
        ask.join(points, ["__by0", "cell"]).filter(F.abs(ask["dq"] - points["r"]) <= ask["bound"] * pv.SLACK).count()) or real(ask, points, *a))
    wt.knn(frame(spark, x, g), 5, "id", "x0", "x1", dims=DIMS, by=["g"]).count()
    assert len(pairs) == 2 and sum(pairs) / len(x) < 0.12 * len(x)


def test_awkward_locations(spark):
    schema = "id long, g string, x0 double, x1 double, x2 double"
    rows = [(1, None, 0.0, 0.0, 0.0), (2, None, 1.0, 0.0, 0.0), (3, "a", 0.0, 0.0, None), (4, "a", 0.0, 1.0, 0.0), (5, "a", 0.0, 1.0, 0.0)]
    got = {(r.src, r.dst, r.d) for r in wt.knn(spark.createDataFrame(rows, schema), 2, "id", "x0", "x1", dims=["x0", "x1", "x2"], by=["g"]).collect()}
    assert (4, 5, 0.0) in got and (5, 4, 0.0) in got
    assert wt.knn(spark.createDataFrame([], schema), 2, "id", "x0", "x1", dims=["x0", "x1", "x2"], by=["g"]).count() == 0


def test_smote_uses_all_columns(spark):
    x, g = clustered(n=300, clusters=10)
    df = frame(spark, x, g)
    out = sp.smote(df, "g", DIMS, seed=10, k=5, id_col="id")
    sizes = {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}
    assert sizes["big"] == sizes["small"] == max(np.unique(g, return_counts=True)[1])
    near = brute(x, g, 5)
    for r in out.filter("synthetic").limit(20).collect():
        v = np.array([r[c] for c in DIMS])
        ok = False
        for (a, _), (b, _) in near.items():
            if g[a] == r["g"]:
                way, off = x[b] - x[a], v - x[a]
                t = off @ way / max(way @ way, 1e-300)
                ok = ok or (-1e-9 <= t <= 1 + 1e-9 and np.abs(off - t * way).max() < 1e-9)
        assert ok
