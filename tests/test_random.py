"""Seeded randomness: seeds give unrelated orders, draws are independent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.functions.expressions import HASH_P, portable_hash
from segstats.operators import sampling as sp
from segstats.operators.spatial import moran as mo
from segstats.operators.spatial import weights as wt
from segstats.plans.label_queries import SAMPLING_SEEDS, SPLIT_SEEDS

KEY = "index_seg"


def test_hash_is_uniform_and_seeds_unrelated(spark):
    df = spark.range(3000).select(*[portable_hash("id", s).alias(f"h{i}") for i, s in enumerate((0, 1, 2, 100, 789729423))])
    x = df.toPandas().to_numpy() / HASH_P
    assert x.min() >= 0 and x.max() < 1 and np.abs(x.mean(0) - 0.5).max() < 0.03
    corr = np.corrcoef(x.T)
    assert np.abs(corr - np.eye(5)).max() < 0.08
    assert all(len(np.unique(x[:, i])) > 2990 for i in range(5))


def test_permutations_differ(spark):
    z = spark.range(60).select(F.col("id").alias("__id"), F.col("id").cast("double").alias("__z"))
    v = np.array([r["__v"] for r in mo.permuted_values(z, range(1, 1000), 12345).orderBy("__id").collect()])
    assert v.shape == (60, 999)
    assert len({tuple(c) for c in v.T}) >= 990
    assert (np.sort(v, 0) == np.arange(60)[:, None]).all()  # every one is a permutation


def test_split_overlaps(spark):
    n = 1000
    s = sp.split_seeds(spark.range(n).withColumnRenamed("id", KEY), SPLIT_SEEDS).filter("part = 'test'")
    tests = {}
    for r in s.collect():
        tests.setdefault(r["seed"], set()).add(r[KEY])
    assert all(len(t) == 200 for t in tests.values())
    for a in SPLIT_SEEDS:
        for b in SPLIT_SEEDS:
            if a < b:
                assert 15 <= len(tests[a] & tests[b]) <= 65  # 40 expected


def test_samples_overlap_as_chance(spark):
    df = spark.range(1000).withColumnRenamed("id", KEY)
    got = [{r[KEY] for r in sp.sample_exact(df, 0.3, s).collect()} for s in SAMPLING_SEEDS]
    for i in range(5):
        for j in range(i):
            assert 60 <= len(got[i] & got[j]) <= 125  # 90 expected
    assert sp.sample_exact(df, 1.0, 502).count() == 1000


def test_smote_draws_are_independent(spark):
    s = spark.range(4000).select(*[sp._uniform(F.col("id"), 30 + i).alias(f"u{i}") for i in range(3)]).toPandas().to_numpy()
    assert np.abs(np.corrcoef(s.T) - np.eye(3)).max() < 0.06


def test_moran_permutation_spread(spark):
    """On a lattice with a smooth value, I lies far outside a spread close to the analytic one."""
    pts = spark.createDataFrame([(i * 15 + j, float(i), float(j), float(i + j)) for i in range(15) for j in range(15)],
                                "id long, x double, y double, value double")
    e = wt.distance_band(pts, 1.01).withColumn("param", F.lit(1.0))
    r = mo.moran_permutations(pts, e, "value", perms=199).first()
    ana = mo.moran(pts, e, ["value"]).first()
    assert r["seI_sim"] > 0 and r["p_sim"] == 1 / 200
    assert abs(r["EI_sim"] - ana["EI"]) < 0.02 and abs(r["z_sim"] / ana["z_norm"] - 1) < 0.2
    noise = pts.withColumn("value", portable_hash("id", 5).cast("double"))
    assert mo.moran_permutations(noise, e, "value", perms=199).first()["p_sim"] > 0.02


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 97, 1000, 4097])
def test_permuted_index_is_a_bijection(spark, n):
    perms = 40 if n < 1000 else 5
    df = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("p"))
    rows = df.select("p", "i", mo.permuted_index(F.col("i"), F.col("p"), n, 7).alias("j")).collect()
    to = np.full((perms + 1, n), -1)
    for r in rows:
        to[r.p, r.i] = r.j
    assert (np.sort(to[1:], 1) == np.arange(n)).all()
    if n >= 97:
        assert len({tuple(x) for x in to[1:]}) == perms
        assert abs(np.corrcoef(to[1:].ravel(), np.tile(np.arange(n), perms))[0, 1]) < 5 / np.sqrt(n * perms)


def test_no_ranking_of_permutations(spark):
    """Values under permutations come from arithmetic: the plan has no window and no sort of nodes x permutations."""
    z = mo.numbered_nodes(spark.range(50).select(F.col("id").alias("__id"), F.col("id").cast("double").alias("__z")))
    seen, real = [], mo.cut_lineage
    mo.cut_lineage = lambda df: seen.append(df._jdf.queryExecution().toString()) or real(df)
    try:
        mo.permuted_values(z, range(1, 100), 3)
    finally:
        mo.cut_lineage = real
    assert len(seen) == 1 and "Window" not in seen[0] and "Join" not in seen[0]


def test_permutations_are_uniform(spark):
    """Spread of I under the permutations is that of the randomisation formula."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=80))], "id long, value double")
    ring = spark.range(80).select(F.col("id").alias("src"), F.explode(F.array(*[F.pmod(F.col("id") + s, F.lit(80)) for s in (-2, -1, 1, 2)])).alias("dst"))
    e = ring.withColumn("param", F.lit(1.0))
    sim = mo.moran_permutations(df, e, "value", perms=999).first()
    exact = mo.moran(df, e, ["value"]).first()
    sd = (exact["I"] - exact["EI"]) / exact["z_rand"]
    assert sim["I"] == pytest.approx(exact["I"]) and abs(sim["EI_sim"] - exact["EI"]) < 4 * sd / 999**0.5
    assert sim["seI_sim"] == pytest.approx(sd, rel=0.1)
