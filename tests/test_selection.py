"""Pairwise information in one pass, margin rows of a kernel machine, pruned resumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators import scaling as sc
from segstats.operators import svm
from segstats.streaming import results


def test_pairs_equal_single_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    rows = [(float(a), float(a + b / 4), None if c < 0.3 else float(c), None if i % 50 == 0 else f"k{int(3 * a)}", 7.0)
            for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y string, flat double").repartition(4)
    cols = ["a", "b", "c", "flat"]
    binned = sc.equal_width_bins(df, cols, 10)
    mi = sc.pairwise_information(binned, cols, 10, "y")
    for j, other in enumerate([*cols, "y"]):
        rest = [c for c in cols if c != other]
        want = {r.feature: r.mi for r in sc.mutual_information(binned, rest, other).collect()}
        for i, c in enumerate(cols):
            if c != other:
                assert mi[i, j] == pytest.approx(want[c], abs=1e-9)
    calls, real = [], sc.pair_counts
    monkeypatch.setattr(sc, "pair_counts", lambda *a: calls.append(1) or real(*a))
    ranked = sc.mrmr(df, cols, "y", k=4).orderBy("rank").collect()
    assert len(calls) == 1 and ranked[0].feature == "a" and len(ranked) == 4
    none = sc.mrmr(df.filter(F.lit(False)), cols, "y", k=2)
    assert none.count() == 0


def ring(spark, n=400):
    rng = np.random.default_rng(1)
    r = np.concatenate((rng.random(n) * 0.9, 1.3 + rng.random(n)))
    t = rng.random(2 * n) * 2 * np.pi
    rows = [(i, float(a * np.cos(b)), float(a * np.sin(b)), "in" if i < n else "out") for i, (a, b) in enumerate(zip(r, t))]
    return r, spark.createDataFrame(rows, "id long, x double, y double, label string")


def test_margin_rows_of_a_ring(spark):
    """The border of a ring-shaped class: a Gaussian machine finds it, a linear one takes nearly every row."""
    r, df = ring(spark)
    found = {k: np.array([row.id for row in svm.margin_rows(df, ["x", "y"], "label", "id", k, c=10.0, gamma=1.0).collect()]) for k in ("rbf", "linear")}
    near = np.abs(r - 1.1)
    assert len(found["linear"]) > 0.9 * len(r) and len(found["rbf"]) < 0.5 * len(r)
    rest = np.setdiff1d(np.arange(len(r)), found["rbf"])
    assert near[found["rbf"]].mean() < 0.6 * near[rest].mean() and len(set(np.argsort(near)[:20]) & set(found["rbf"])) >= 14
    with pytest.raises(ValueError):
        svm.margin_rows(df, ["x"], "label", "id", "poly")
    assert svm.margin_rows(df.filter("id < 0"), ["x", "y"], "label", "id").count() == 0


def test_fourier_features_approach_the_kernel(spark):
    _, df = ring(spark, 20)
    rows = df.select("x", "y", svm.fourier(["x", "y"], 4000, 0.5).alias("z")).collect()
    z, x = np.array([r.z for r in rows]), np.array([(r.x, r.y) for r in rows])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.12


def test_resume_reads_touched_partitions(spark, tmp_path):
    rows = [(f"r{i}", i % 7, float(i)) for i in range(200)]
    schema = "run_id string, seed int, score double"
    src, table, ckpt = (str(tmp_path / x) for x in ("in", "table", "ckpt"))
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{src}/a")
    results.ingest_runs(spark, f"{src}/*", df.schema, table, ckpt, ["run_id", "seed"])
    more = spark.createDataFrame([*rows[:3], ("new", 1, 0.5), ("new", 1, 0.5), (None, 2, 1.5)], schema)
    more.write.parquet(f"{src}/b")
    results.ingest_runs(spark, f"{src}/*", df.schema, table, ckpt, ["run_id", "seed"])
    more.limit(0).write.parquet(f"{src}/c")
    spark.createDataFrame([(None, 2, 1.5)], schema).write.parquet(f"{src}/d")
    results.ingest_runs(spark, f"{src}/*", df.schema, table, ckpt, ["run_id", "seed"])
    out = results.read_runs(spark, table)
    assert out.columns == ["run_id", "seed", "score", "ingest_epoch"] and out.count() == 202
    assert out.filter("ingest_epoch > 0").count() == 2
    have = results.known_keys(spark, table, ["run_id", "seed"], [3, 5])
    plan = have._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [key_bucket" in plan
    assert results.known_keys(spark, str(tmp_path / "none"), ["run_id"], [1]) is None
