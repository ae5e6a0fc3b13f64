"""Hand-made edge cases and properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round, half_even_round, normal_sf
from segstats.functions.pvalues import student_t_two_sided
from segstats.operators import metrics as mt
from segstats.operators import reports as rp
from segstats.operators import sampling as sp
from segstats.operators.spatial import gstar as gs
from segstats.operators.spatial import moran as mo
from segstats.operators.spatial import weights as wt


def test_bounded_round_edges(spark):
    vals = [0.5, 1.0, 1.8, 2.5, 2.6, 3.4, 4.2, 5.0, 5.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(bounded_round("x", 1, 5)).collect()]
    assert got == [0, 1, 2, 2, 3, 4, 5, 6, 6]
    got = [r[0] for r in df.select(bounded_round("x", 1, 5, closed_right=True)).collect()]
    assert got == [0, 1, 2, 2, 3, 4, 5, 5, 6]


def test_half_even(spark):
    df = spark.createDataFrame([(v,) for v in [0.5, 1.5, 2.5, 3.5]], "x double")
    assert [r[0] for r in df.select(half_even_round("x")).collect()] == [0.0, 2.0, 2.0, 4.0]


def test_normal_sf_accuracy(spark):
    zs = [0.0, 0.5, 1.0, 1.644854, 1.96, 3.0, 4.858226105513263, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_sf("z")).collect()]
    for z, p in zip(zs, got):
        exact = 0.5 * math.erfc(z / math.sqrt(2))
        assert abs(p - exact) <= 1.3e-7 * exact + 1e-300


def test_student_t():
    assert abs(student_t_two_sided(2.0, 10) - 0.0733880347707) < 1e-9
    assert abs(student_t_two_sided(1.959964, 1e7) - 0.05) < 1e-5


def test_hash_rank_exact_with_hot_group(spark):
    # one class holds most rows; buckets force the distributed path
    rows = [(i, 0 if i % 10 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "index_seg long, cls int")
    r = sp.hash_rank(df, "index_seg", 5, by=("cls",), n_buckets=7).collect()
    by = {}
    for x in r:
        by.setdefault(x["cls"], []).append(x["rank"])
    for c, ranks in by.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_split_disjoint_complete(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "index_seg")
    s = sp.split_seeds(df, [0, 100]).collect()
    for seed in (0, 100):
        parts = [x for x in s if x["seed"] == seed]
        assert len({x["index_seg"] for x in parts}) == 1000
        assert sum(x["part"] == "test" for x in parts) == 200


def test_k_fold_sizes(spark):
    df = spark.range(0, 23).withColumnRenamed("id", "index_seg")
    folds = [r["fold"] for r in sp.k_fold(df, 1, 5).collect()]
    assert sorted([folds.count(k) for k in range(5)], reverse=True) == [5, 5, 5, 4, 4]


def _pts(spark, n=300, seed=3, dup=True):
    rnd = random.Random(seed)
    pts = [(i, rnd.random(), rnd.random(), float(rnd.randint(0, 4))) for i in range(n)]
    if dup:  # coincident points and an exact tie
        pts.append((n, pts[0][1], pts[0][2], 1.0))
    return spark.createDataFrame(pts, "id long, x double, y double, value double"), pts


def _brute_band(pts, t):
    out = set()
    for a in pts:
        for b in pts:
            if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= t * t:
                out.add((a[0], b[0]))
    return out


def test_band_salted_equals_plain(spark):
    df, pts = _pts(spark)
    plain = {(r[0], r[1]) for r in wt.distance_band(df, 0.1).collect()}
    salted = {(r[0], r[1]) for r in wt.distance_band(df, 0.1, hot_rows=3).collect()}
    assert plain == salted == _brute_band(pts, 0.1)


def test_band_symmetric(spark):
    df, _ = _pts(spark)
    e = {(r[0], r[1]) for r in wt.distance_band(df, 0.07).collect()}
    assert all((b, a) in e for a, b in e)


def test_knn_matches_brute_force(spark):
    df, pts = _pts(spark, n=150)
    got = {}
    for r in wt.knn(df, 4).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for a in pts:
        cand = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in pts if b[0] != a[0])
        want = [dst for _, dst in cand[:4]]
        assert [d for _, d in sorted(got[a[0]])] == want


def test_moran_constant_column_is_null(spark):
    df, _ = _pts(spark, n=50, dup=False)
    df = df.withColumn("const", F.lit(2.0))
    e = wt.distance_band(df, 0.3).withColumn("param", F.lit(0.3))
    out = mo.moran(df, e, ["const", "value"], symmetric=True).collect()
    assert [r for r in out if r["column"] == "value"]
    assert not [r for r in out if r["column"] == "const" and r["I"] is not None]


def test_moran_symmetric_equals_general(spark):
    df, _ = _pts(spark, n=120, dup=False)
    e = wt.inverse_distance_weights(wt.distance_band(df, 0.2)).withColumn("param", F.lit(0.2))
    a = mo.moran(df, e, ["value"], symmetric=True).first()
    b = mo.moran(df, e, ["value"], symmetric=False).first()
    for k in ("I", "z_norm", "z_rand"):
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_gstar_island_z(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 10.0, 10.0, 3.0), (2, 10.1, 10.0, 5.0)],
                               "id long, x double, y double, value double")
    e = wt.distance_band(df, 0.5)
    g = {r["id"]: r["Zs"] for r in gs.local_gstar(df, e).collect()}
    m, s = 3.0, math.sqrt(8.0 / 3.0)
    assert g[0] == pytest.approx((1.0 - m) / s)


def test_scores_properties(spark):
    rows = [(t, p) for t in range(1, 6) for p in range(1, 6) for _ in range((t * p) % 4 + 1)]
    rows += [(6, 6)]  # a label present in truth and prediction only here
    df = spark.createDataFrame(rows, "t long, p long")
    sc = mt.classification_scores(df, "t", "p").first()
    acc = sum(t == p for t, p in rows) / len(rows)
    assert sc["f1_micro"] == pytest.approx(acc)
    cm = mt.confusion_matrix(df, "t", "p", [1, 2, 3, 4, 5]).collect()
    assert sum(sum(r[f"p{v}"] for v in range(1, 6)) for r in cm) == len(rows) - 1


def test_kruskal_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(g, "f", float(rnd.randint(0, 6))) for g in range(3) for _ in range(20 + 5 * g)]
    df = spark.createDataFrame(rows, "grp int, feature string, value double")
    h = mt.kruskal_h(df, "grp").first()["H"]
    vals = sorted(v for _, _, v in rows)
    n = len(vals)
    mid = {}
    for v in set(vals):
        first = vals.index(v) + 1
        cnt = vals.count(v)
        mid[v] = first + (cnt - 1) / 2
    rs = {}
    for g, _, v in rows:
        rs.setdefault(g, []).append(mid[v])
    hh = 12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in rs.values()) - 3 * (n + 1)
    ties = sum(vals.count(v) ** 3 - vals.count(v) for v in set(vals))
    assert h == pytest.approx(hh / (1 - ties / (n ** 3 - n)))


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rnd = random.Random(2)
    rows = [("a" if i % 5 else "b", float(rnd.randint(0, 30))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in rp.exact_quantiles(df, "v", ["g"], [0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b"):
        arr = np.array([v for gg, v in rows if gg == g])
        for q in (0.25, 0.5, 0.9):
            assert got[(g, q)] == pytest.approx(float(np.quantile(arr, q)))


def test_moran_permutation_bounds(spark):
    df, _ = _pts(spark, n=200, dup=False)
    df = df.withColumn("trend", F.col("x") + F.col("y"))
    e = wt.distance_band(df, 0.15).withColumn("param", F.lit(0.15))
    r = mo.moran_permutations(df, e, "trend", perms=49).first()
    assert r["p_sim"] == pytest.approx(1 / 50)
    r = mo.moran_permutations(df, e, "value", perms=49).first()
    assert 1 / 50 <= r["p_sim"] <= 1.0


def test_smote_counts(spark):
    rnd = random.Random(5)
    rows = [(i, 1 if i < 60 else (2 if i < 80 else 3), rnd.random(), rnd.random(), rnd.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "index_seg long, cls int, a double, b double, c double")
    out = sp.smote(df, "cls", ["a", "b", "c"], k=5)
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts == {1: 60, 2: 60, 3: 60}
    # synthetic rows lie inside the class's bounding box
    for c in (2, 3):
        src = [r for r in rows if r[1] == c]
        syn = out.filter((F.col("cls") == c) & F.col("synthetic")).collect()
        for col, i in (("a", 2), ("b", 3)):
            lo, hi = min(r[i] for r in src), max(r[i] for r in src)
            assert all(lo - 1e-12 <= s[col] <= hi + 1e-12 for s in syn)


def test_knn_duplicates_and_dense_region(spark):
    # a third of the points share one coordinate, another third sit in a tiny
    # dense square; the rest are spread out. Compare with brute force.
    rnd = random.Random(11)
    pts = []
    for i in range(180):
        if i % 3 == 0:
            pts.append((i, 0.5, 0.5, 0.0))
        elif i % 3 == 1:
            pts.append((i, 0.2 + rnd.random() * 1e-3, 0.7 + rnd.random() * 1e-3, 0.0))
        else:
            pts.append((i, rnd.random(), rnd.random(), 0.0))
    df = spark.createDataFrame(pts, "id long, x double, y double, value double")
    got = {}
    for r in wt.knn(df, 5, dense_rows=8).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for a in pts:
        cand = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in pts if b[0] != a[0])
        assert [d for _, d in sorted(got[a[0]])] == [dst for _, dst in cand[:5]]


def test_all_null_group_sum_stays_null(spark):
    from segstats.operators import features as ft
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "index_seg long, a double")
    got = {r["index_seg"]: r["a"] for r in ft.sum_per_segment(df).collect()}
    assert got == {1: None, 2: 3.0}


def test_density_boundary_keeps_exactly_ten_percent(spark):
    from segstats.operators import features as ft
    rows = [(i, 1.0 if i == 0 else None, 1.0 if i < 2 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "index_seg long, one double, two double")
    assert ft.keep_dense_columns(df, ["one", "two"], 0.1) == ["one", "two"]
    assert ft.keep_dense_columns(df, ["one", "two"], 0.15) == ["two"]


def test_island_neighbour_mean_is_zero(spark):
    from segstats.operators.spatial import lag
    df = spark.createDataFrame([(0, 0.0, 0.0, 5.0), (1, 0.01, 0.0, 7.0), (2, 9.0, 9.0, 3.0)],
                               "id long, x double, y double, f double")
    got = {r["id"]: r["f_neighbor"] for r in lag.neighbour_mean(df, wt.distance_band(df, 0.1), ["f"]).collect()}
    assert got == {0: 7.0, 1: 5.0, 2: 0.0}


def test_inverse_weight_at_zero_distance_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.3, 1.0)], "id long, x double, y double")
    w = {(r["src"], r["dst"]): r["w"] for r in wt.inverse_distance_weights(wt.distance_band(df, 0.5)).collect()}
    assert w[(0, 1)] is None and w[(1, 0)] is None
    assert w[(0, 2)] == pytest.approx(1 / 0.3)


def test_label_only_in_predictions_counts_in_macro(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 3), (2, 2)], "t long, p long")
    sc = mt.classification_scores(df, "t", "p").first()
    # labels 1, 2, 3: f1 = 1, 2/3, 0 -> macro 5/9
    assert sc["f1_macro"] == pytest.approx(5 / 9)
    assert sc["f1_micro"] == pytest.approx(0.75)


def test_smote_leaves_tiny_class(spark):
    rnd = random.Random(9)
    rows = [(i, 1 if i < 40 else 2, rnd.random(), rnd.random()) for i in range(44)]
    df = spark.createDataFrame(rows, "index_seg long, cls int, a double, b double")
    counts = {r["cls"]: r["count"] for r in sp.smote(df, "cls", ["a", "b"], k=5).groupBy("cls").count().collect()}
    assert counts == {1: 40, 2: 4}


def test_matrices_sink_partitions(spark, tmp_path):
    from segstats.sources import sinks
    df = spark.createDataFrame([(1, 2.0, "TOTAL", "~1999"), (2, 3.0, "NO_TOTAL", "~2000")],
                               "index_seg long, a double, total string, years string")
    out = str(tmp_path / "m")
    sinks.write_matrices(df, out)
    back = spark.read.parquet(out)
    assert sorted((r["total"], r["years"]) for r in back.select("total", "years").collect()) == \
        [("NO_TOTAL", "~2000"), ("TOTAL", "~1999")]
    assert back.filter(F.col("total") == "TOTAL").count() == 1


def test_stream_ingest_is_exactly_once(spark):
    import __spark_entry__ as E
    df = E.queries()["stream_runs"](spark, "/root/testdata/sf0.001")
    n = df.count()
    assert n == df.select("run_id", "seed").distinct().count() > 0


def test_distribution_tails():
    from segstats.functions.pvalues import chi2_sf, f_test_p
    # reference values: chi2(df=2) sf(x) = exp(-x/2); F(1, d) tail = t(d) two-sided at sqrt(f)
    assert chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert chi2_sf(30.0, 2) == pytest.approx(math.exp(-15.0), rel=1e-10)
    assert chi2_sf(3.84145882, 1) == pytest.approx(0.05, rel=1e-6)
    assert f_test_p(4.0, 1, 10) == pytest.approx(student_t_two_sided(2.0, 10), rel=1e-12)
    assert f_test_p(0.0, 2, 5) == 1.0
