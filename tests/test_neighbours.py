"""Sums over neighbours without edges against the operators on edge tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators.spatial import gstar as gs
from segstats.operators.spatial import lag
from segstats.operators.spatial import moran as mo
from segstats.operators.spatial import neighbours as nb
from segstats.operators.spatial import weights as wt

BANDS = [0.1, 0.25]


@pytest.fixture(scope="module")
def pts(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), float(rng.randint(0, 9)), rng.random()) for i in range(150)]
    rows += [(200 + i, 0.5, 0.5, float(i), None) for i in range(6)]  # one spot
    rows += [rows[3], (7, 0.9, 0.9, 1.0, 0.5), (None, 0.5, 0.5, 3.0, 1.0), (300, None, 0.5, 2.0, 0.1), (301, 0.4, 0.4, None, 0.2), (302, 50.0, 50.0, 4.0, 0.3)]
    return spark.createDataFrame(rows, "id long, x double, y double, value double, f double").repartition(3)


def rounded(df):
    def plain(v):
        return "none" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("inverse", [False, True])
def test_moran_of_bands_is_that_of_their_edges(spark, pts, inverse):
    e = wt.band_family(pts, BANDS)
    e = wt.inverse_distance_weights(e) if inverse else wt.binary_weights(e)
    params = spark.createDataFrame([(b,) for b in BANDS], "param double")
    want = mo.moran(pts, e, ["value", "f"], params=params, symmetric=True)
    assert rounded(mo.band_moran(pts, BANDS, ["value", "f"], inverse=inverse)) == rounded(want)


def test_spots_and_means_of_bands(pts):
    want = gs.local_gstar(pts, wt.band_family(pts, BANDS), params=BANDS)
    assert rounded(gs.band_gstar(pts, BANDS).select(want.columns)) == rounded(want)
    odd = pts.withColumn("f", F.when(F.col("id") == 9, float("nan")).when(F.col("id") == 30, float("inf")).otherwise(F.col("f")))
    want = lag.neighbour_mean(odd, wt.distance_band(odd, 0.1), ["value", "f"], fill=None)
    assert rounded(lag.band_neighbour_mean(odd, 0.1, ["value", "f"], fill=None)) == rounded(want)


def test_permutations_of_a_band(pts):
    e = wt.distance_band(pts, 0.25).withColumn("param", F.lit(0.25))
    want = mo.moran_permutations(pts, e, "value", perms=40, block=16)
    assert rounded(mo.band_permutations(pts, 0.25, "value", perms=40, block=16)) == rounded(want)


def test_runs_within_a_band_count_as_sums(monkeypatch):
    """Skipped, summed and compared runs give what all pairs give."""
    monkeypatch.setattr(nb, "RUN", 8)
    rng = np.random.default_rng(2)
    a, b = (np.sort(rng.random((n, 2)), axis=0) for n in (61, 90))
    ids, other = rng.integers(0, 70, 61), rng.integers(0, 70, 90)
    v, bands = rng.normal(size=(90, 3)), np.array([0.05, 0.3, 2.0])
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    for inverse in (False, True):
        got = np.zeros((3, 61, 4))
        for lo, k, out in nb.band_sums((ids, a), (other, b), bands, [v] * 3, np.array([1, 1, 2]), inverse):
            got[k, lo:lo + len(out)] += out
        for k, band in enumerate(bands):
            inside = (d2 <= band * band) & (ids[:, None] != other[None])
            w = inside / np.sqrt(d2) if inverse else inside.astype(float)
            assert np.allclose(got[k], np.column_stack((inside.sum(1), w @ v[:, :2], (w ** 2) @ v[:, 2:])))
