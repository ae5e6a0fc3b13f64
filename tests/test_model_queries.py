"""Properties of the queries that SQL cannot express (fits, resampling, files, permutations)."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from segstats.operators import bagging
from segstats.operators import experiments as ex
from segstats.operators import linear
from segstats.operators import models as ml
from segstats.operators import scaling as sc
from segstats.plans import QUERIES
from segstats.plans import geometry_queries as gq
from segstats.plans import model_queries as mq
from segstats.sources import testdata as td
from tests.conftest import SF_SMALL

# queries checked here by their own result or by the operator they run
CHECKED = ["geojson_features", "geojson_scan", "grid_search", "grid_search_stored", "train_naive_bayes", "group_tests", "group_tests_two", "pearson_p", "importance_summary", "model_sweep", "moran_permutation", "mrmr_rank",
           "neighbour_columns_selected", "oof_predictions", "rfecv_linsvc", "run_experiments", "experiment_best", "score_population",
           "smote_before_split", "smote_margin", "smote_regular", *[f"train_m{i}" for i in range(1, 11)], "variance_mask"]
KEY = "index_seg"


def run(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


@pytest.fixture(scope="module")
def signal(spark):
    """A label that depends on two of three columns: 1..5 in equal parts."""
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = np.floor((x[:, 0] + x[:, 1]).argsort().argsort() / 60) + 1
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"{KEY} long, a double, b double, c double, y double").cache()


OVER = {"GDBreg": {"maxIter": 15}, "GDBcls": {"maxIter": 5}, "XGBreg": {"maxIter": 8}, "XGBcls": {"maxIter": 4, "maxDepth": 4},
        "MLPcls": {"hidden": [16], "maxIter": 150}, "ridge": {"regParam": 0.01}, "lasso": {"regParam": 0.01}, "linearSVM": {"maxIter": 50}}


@pytest.mark.parametrize("name", [*ml.REG_MODELS, *ml.CLS_MODELS])
def test_models_learn(signal, name):
    tr, te = signal.filter(f"{KEY} % 4 > 0").withColumn("label", F.col("y")), signal.filter(f"{KEY} % 4 = 0").withColumn("label", F.col("y"))
    kind = ml.kind_of(name)
    out = ml.evaluate(ml.fit(name, tr, ["a", "b", "c"], n_classes=7, **OVER.get(name, {})).transform(te), kind).first()
    assert out["f1_micro"] > 0.4  # 0.2 by always predicting one class
    if kind == "reg":
        assert out["mse"] < 0.6  # the label's variance is 2


def test_param_grids():
    assert all(len(ml.param_grid(n)) > 1 for n in ml.GRIDS) and ml.param_grid("ols") == [{}]
    assert set(ml.GRIDS) | {"ols"} == set(ml.REG_MODELS) | set(ml.CLS_MODELS)
    for n in ml.GRIDS:
        for p in ml.param_grid(n):
            ml.estimator(n, 3, 5, **p)


def test_grid_search_finds_the_weak_penalty(signal):
    tr = signal.withColumn("label", F.col("y")).withColumn("fold", F.col(KEY) % 3)
    model, table = ml.grid_search("ridge", tr, ["a", "b", "c"], grid=[{"regParam": 10.0}, {"regParam": 0.001}])
    rows = table.collect()
    assert "0.001" in rows[0]["params"] and rows[0]["cv_metric"] < rows[1]["cv_metric"]
    assert "prediction" in model.transform(tr).columns


@pytest.mark.parametrize("name, grid", [("ols", [{}]), ("ridge", [{"regParam": r} for r in (0.01, 0.3, 10.0)]),
                                        ("lasso", [{"regParam": r} for r in (0.001, 0.1, 5.0)]), ("lasso", [{"regParam": 0.2, "elasticNetParam": 0.5}])])
def test_one_pass_grid_equals_single_fits(spark, signal, name, grid, monkeypatch):
    rng = np.random.default_rng(4)
    more = spark.createDataFrame([(i, float(v), 3.0) for i, v in enumerate(rng.random(300))], f"{KEY} long, d double, flat double")
    tr = signal.join(more, KEY).withColumn("d", F.col("a") + 0.05 * F.col("d")).withColumn("label", F.col("y")).withColumn(
        "fold", F.col(KEY) % 3).cache()  # d is nearly a, flat is constant
    cols = ["a", "b", "c", "d", "flat"]
    tight = {"tol": 1e-13, "maxIter": 5000} if name == "lasso" else {}  # by default Spark ML stops early on nearly equal columns
    want = ml.fitted_means(name, tr, cols, "fold", None, 4, 0, [{**p, **tight} for p in grid])
    calls, real = [], linear.grams
    monkeypatch.setattr(linear, "grams", lambda *a: calls.append(1) or real(*a))
    got = linear.grid_mse(tr, cols, "label", "fold", [
        (p.get("regParam", ml.LEAST_SQUARES[name][0]), p.get("elasticNetParam", ml.LEAST_SQUARES[name][1])) for p in grid])
    assert got == pytest.approx(want, rel=1e-4) and len(calls) == 1


def test_svm_grid_equals_single_fits(signal):
    tr = signal.withColumn("label", F.col("y")).withColumn("fold", F.col(KEY) % 3)
    grid = [{"C": 0.01}, {"C": 10.0}]
    model, table = ml.grid_search("linearSVM", tr, ["a", "b", "c"], grid=grid)
    want = ml.fitted_means("linearSVM", tr, ["a", "b", "c"], "fold", None, 4, 0, grid)
    got = {r["params"]: r["cv_metric"] for r in table.collect()}
    assert [got[str(p)] for p in grid] == pytest.approx(want, abs=0.02)
    assert model.transform(tr).filter("prediction = y").count() > 150


def test_stored_grid_search(signal, tmp_path, monkeypatch):
    tr = signal.withColumn("label", F.col("y")).withColumn("fold", F.col(KEY) % 3)
    grid = [{"maxDepth": 1}, {"maxDepth": 4, "featureSubsetStrategy": "1.0"}]
    first, table = ml.stored_grid_search("DTcls", tr, ["a", "b", "c"], str(tmp_path / "g"), grid=grid)
    assert [r["place"] for r in table.orderBy("place").collect()] == [0, 1] and "4" in table.orderBy("place").first()["params"]
    monkeypatch.setattr(ml, "grid_search", None)  # the second call must not search
    again, _ = ml.stored_grid_search("DTcls", tr, ["a", "b", "c"], str(tmp_path / "g"))
    same = [m.transform(tr).orderBy(KEY).select("prediction").collect() for m in (first, again)]
    assert same[0] == same[1]


def test_naive_bayes_query(spark):
    r = run(spark, "train_naive_bayes")[0]
    assert r["model_name"] == "GNBcls" and 0 < r["f1_micro"] <= 1


def test_grid_search_stored_query(spark):
    rows = run(spark, "grid_search_stored")
    assert len(rows) == 10 and [r["cv_metric"] for r in rows] == sorted(r["cv_metric"] for r in rows)


@pytest.mark.parametrize("kind", ["reg", "cls"])
def test_bagging_draws_columns_per_tree(signal, kind, monkeypatch):
    monkeypatch.setattr(bagging, "MASKS", 4)
    tr = signal.filter(f"{KEY} % 4 > 0").withColumn("label", F.col("y") - 1)
    x = ml.assemble(tr, ["a", "b", "c"])
    model = bagging.BaggedTrees(kind, "features", "label", numTrees=6, maxFeatures=0.7, maxDepth=5).fit(x)
    masks = [tuple(c) for c, _ in model.forests]
    assert [f.getNumTrees for _, f in model.forests] == [2, 2, 1, 1] and len(set(masks)) > 1
    assert all(len(c) == 2 and f.numFeatures == 2 for c, f in model.forests)  # a tree cannot use other columns
    drawn = {i for c, _ in model.forests for i in c}
    assert sum(model.featureImportances) == pytest.approx(1) and {i for i, v in enumerate(model.featureImportances) if v} <= drawn
    te = ml.assemble(signal.filter(f"{KEY} % 4 = 0").withColumn("label", F.col("y") - 1), ["a", "b", "c"])
    out = model.transform(te)
    base = te.groupBy("label").count().agg(F.max("count")).first()[0]
    assert out.columns == [*te.columns, *(["probability"] if kind == "cls" else []), "prediction"]
    assert out.filter("round(prediction) = label").count() > 1.3 * base
    assert model.transform(te).select("prediction").collect() == out.select("prediction").collect()
    one = [len(c) for c, _ in bagging.draw_masks(3, 100, 0.1, 1)]
    assert one == [1] * 4


@pytest.mark.parametrize("kind", ["reg", "cls"])
def test_many_bagged_forests_are_scored(signal, kind):
    """32 forests: the plan of their predictions stays small, and it is the mean of the trees' votes."""
    x = ml.assemble(signal.withColumn("label", F.col("y") - 1), ["a", "b", "c"]).limit(60)
    model = bagging.BaggedTrees(kind, "features", "label", numTrees=33, maxFeatures=0.7, maxDepth=2).fit(x)
    out = model.transform(x)
    assert len(model.forests) == 32 and len(out._jdf.queryExecution().toString()) < 20_000
    for r in out.limit(5).collect():
        votes = [(f.predictProbability if kind == "cls" else f.predict)(Vectors.dense([r["features"][c] for c in columns])) for columns, f in model.forests]
        weight = [f.getNumTrees / 33 for _, f in model.forests]
        if kind == "reg":
            assert r["prediction"] == pytest.approx(sum(v * w for v, w in zip(votes, weight)))
        else:
            assert r["probability"].toArray() == pytest.approx(sum(v.toArray() * w for v, w in zip(votes, weight)))


def test_score_population(spark):
    rows = run(spark, "score_population")
    n = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    labelled = td.labels(spark, SF_SMALL).count()
    assert len(rows) == n and sum(r["y_cls"] is not None for r in rows) == labelled
    for r in rows:
        assert math.isclose(sum(r["proba"]), 1, abs_tol=1e-5) and math.isclose(max(r["proba"]), r["max_proba"], abs_tol=1e-5)


def test_oof_predictions(spark):
    rows = run(spark, "oof_predictions")
    assert len({r[KEY] for r in rows}) == len(rows) == td.labels(spark, SF_SMALL).count()
    n = Counter(r["fold"] for r in rows)
    assert set(n) == set(range(5)) and max(n.values()) - min(n.values()) <= 1
    assert {r["prediction"] for r in rows} <= {r["label"] for r in rows}


def test_importances(spark):
    rows = run(spark, "importance_summary")
    assert {r["feature"] for r in rows} == set(mq.COLS)
    assert math.isclose(sum(r["importance_mean"] for r in rows), 1, abs_tol=1e-4)
    assert all(r["importance_std"] > 0 for r in rows if r["importance_mean"] > 0.05)


def check_smote(rows, original, k=5):
    """Classes of more than k rows reach the largest; synthetic rows lie between two rows of their class."""
    by = {}
    for r in original:
        by.setdefault(r["y_cls"], []).append([r[c] for c in mq.COLS])
    top = max(map(len, by.values()))
    n = Counter(r["y_cls"] for r in rows)
    assert n == {c: top if len(v) > k else len(v) for c, v in by.items()}
    for r in rows:
        if r["synthetic"]:
            v, x = np.array(by[r["y_cls"]]), np.array([r[c] for c in mq.COLS])
            assert (x >= v.min(0) - 1e-5).all() and (x <= v.max(0) + 1e-5).all()


def test_smote_regular(spark):
    rows = run(spark, "smote_regular")
    check_smote(rows, mq.smote_input(spark, SF_SMALL).collect())
    new = [tuple(r[c] for c in mq.COLS) for r in rows if r["synthetic"]]
    assert len(set(new)) > 0.9 * len(new)  # draws differ


def test_smote_margin(spark):
    rows = run(spark, "smote_margin")
    original = {r["y_cls"] for r in mq.smote_input(spark, SF_SMALL).collect()}
    assert {r["y_cls"] for r in rows} == original and any(r["synthetic"] for r in rows)


def test_smote_before_split(spark):
    rows = run(spark, "smote_before_split")
    assert len({r[KEY] for r in rows}) == len(rows)
    test = [r for r in rows if r["part"] == "test"]
    assert len(test) == math.ceil(0.2 * len(rows)) and any(r["synthetic"] for r in test) and any(not r["synthetic"] for r in test)


def test_mrmr_by_brute_force(spark):
    train, _ = mq.model_data(spark, SF_SMALL)
    data = train.select(*mq._BIN_COLS, "y_cls").toPandas()
    bins = {}
    for c in mq._BIN_COLS:
        lo, hi = data[c].min(), data[c].max()
        bins[c] = np.minimum(np.floor((data[c] - lo) / ((hi - lo) / 10)), 9).astype(int) if hi > lo else np.zeros(len(data), int)

    def mi(a, b):
        n = len(a)
        ab, ca, cb = Counter(zip(a, b)), Counter(a), Counter(b)
        return sum(x / n * math.log(x * n / (ca[i] * cb[j])) for (i, j), x in ab.items())

    chosen = []
    while len(chosen) < 4:
        score = {c: mi(bins[c], data["y_cls"]) - (sum(mi(bins[c], bins[o]) for o in chosen) / len(chosen) if chosen else 0)
                 for c in mq._BIN_COLS if c not in chosen}
        chosen.append(max(score, key=lambda c: (score[c], -mq._BIN_COLS.index(c))))
    got = sorted(run(spark, "mrmr_rank"), key=lambda r: r["rank"])
    assert [r["feature"] for r in got] == chosen
    assert math.isclose(got[0]["relevance"], mi(bins[chosen[0]], data["y_cls"]), abs_tol=1e-5)


def test_variance_mask(spark):
    train, test = mq.model_data(spark, SF_SMALL)
    var = train.select(*mq.COLS).toPandas().var(ddof=0)
    out = QUERIES["variance_mask"](spark, SF_SMALL)
    assert [c for c in out.columns if c not in (KEY, "part")] == [c for c in mq.COLS if var[c] > 0.01]
    assert out.count() == train.count() + test.count()


def test_rfecv(signal):
    tr = signal.withColumn("label", (F.col("y") > 3).cast("double")).withColumn("fold", F.col(KEY) % 3)
    chosen, table = ml.rfecv("linearSVM", tr, ["a", "b", "c"], "fold", maxIter=30)
    rows = {r["n_features"]: r["cv_accuracy"] for r in table.collect()}
    assert set(rows) == {1, 2, 3} and rows[2] > rows[1] and {"a", "b"} <= set(chosen)


def test_experiment_resumes_and_skips(spark, signal, tmp_path):
    path = str(tmp_path / "results")
    plan = spark.createDataFrame([("ridge", c, s, u, 0) for c, s, u in [("all", "", ""), ("all", "variance", "naive"), ("flat", "variance", ""),
                                                                       ("all", "mrmr", "under"), ("all", "", "smote")]], ",".join(
        f"{k} {'int' if k == 'seed' else 'string'}" for k in ex.RUN_KEYS))
    data = signal.withColumn("flat", F.lit(1.0)).withColumnRenamed("y", "csl")
    combos = {"all": ["a", "b", "c"], "flat": ["flat"]}
    few = data.filter("csl < 3 or index_seg < 12")  # the other classes have at most five rows
    one = ex.run_experiments(plan.limit(2), data, combos, path).collect()
    rows = ex.run_experiments(plan, data, combos, path).collect()
    assert len(one) == 2 and len(rows) == 5 and len({tuple(r[k] for k in ex.RUN_KEYS) for r in rows}) == 5
    by = {(r["ftr_combo_name"], r["feature_selection"], r["upsample"]): r for r in rows}
    assert by["flat", "variance", ""]["skipped"] == "nothing selected" and by["flat", "variance", ""]["test_f1_micro"] is None
    assert by["all", "mrmr", "under"]["n_features"] == 1
    assert by["all", "", ""]["skipped"] is None and by["all", "", ""]["test_f1_micro"] > 0.4
    assert ex.run_experiments(plan, data, combos, path).count() == 5
    same = few.filter("csl < 2")
    none = ex.run_experiments(plan.filter("upsample = 'smote'"), same, combos, str(tmp_path / "other")).collect()
    assert [r["skipped"] for r in none] == ["resampling impossible"]


def test_permutation_query(spark):
    r = run(spark, "moran_permutation")[0]
    assert r["seI_sim"] > 0 and r["permutations"] == 999 and 1 / 1000 <= r["p_sim"] <= 0.5
    assert abs(r["EI_sim"]) < 0.05


def test_geojson_round_trip(spark):
    want = {r["id"]: r for r in gq.geojson_lines_of(spark, SF_SMALL).collect()}
    rows = run(spark, "geojson_scan")
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["id"]]
        assert math.isclose(r["value"], w["value"], abs_tol=1e-6)
    for r in run(spark, "geojson_features"):
        f = json.loads(r[0])
        assert f["type"] == "Feature" and f["geometry"]["coordinates"] == want[f["properties"]["id"]]["coordinates"]


def test_neighbour_columns_selected(spark):
    from segstats.plans.spatial_queries import BANDS, FEATS, _band_moran

    sig = {r["column"] for r in _band_moran(spark, SF_SMALL, BANDS, FEATS).filter((F.col("param") == BANDS[0]) & (F.col("p_rand") < 0.05)).collect()}
    out = QUERIES["neighbour_columns_selected"](spark, SF_SMALL)
    assert set(out.columns) == {"id", *FEATS} | {f"{c}_neighbor" for c in FEATS if c in sig}
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()


def test_minmax_is_fitted_on_train_only(spark):
    train, _ = mq.model_data(spark, SF_SMALL)
    r = train.agg(*[F.min(c).alias(f"lo_{c}") for c in mq.COLS], *[F.max(c).alias(f"hi_{c}") for c in mq.COLS]).first()
    assert all(r[f"lo_{c}"] == 0 and r[f"hi_{c}"] in (0, 1) for c in mq.COLS)
    assert sc.variance_select(train, mq.COLS, 10.0) == []


def tail(density, x, n=400_001):
    """Upper tail of a density by the midpoint rule on t = x + u / (1 - u)."""
    u = (np.arange(n) + 0.5) / n
    return float((density(x + u / (1 - u)) / (1 - u) ** 2).mean())


def f_density(a, b):
    k = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
    return lambda t: k * t ** (a / 2 - 1) * (1 + a * t / b) ** (-(a + b) / 2)


def chi2_density(a):
    k = 1 / (2 ** (a / 2) * math.gamma(a / 2))
    return lambda t: k * t ** (a / 2 - 1) * np.exp(-t / 2)


def t_density(a):
    k = math.exp(math.lgamma((a + 1) / 2) - math.lgamma(a / 2)) / math.sqrt(a * math.pi)
    return lambda t: k * (1 + t * t / a) ** (-(a + 1) / 2)


@pytest.mark.parametrize("name", ["group_tests", "group_tests_two"])
def test_group_tests(spark, name):
    rows = run(spark, name)
    assert rows
    for r in rows:
        assert r["anova1way_p"] == pytest.approx(tail(f_density(r["df_between"], r["df_within"]), r["F"]), abs=2e-4)
        assert r["kruskal_p"] == pytest.approx(tail(chi2_density(r["df"]), r["H"]), abs=2e-4)
        for p, level in (("anova1way_p", "anova1way_siglv"), ("kruskal_p", "kruskal_siglv")):
            assert r[level] == (2 if r[p] < 0.001 else 1 if r[p] < 0.01 else 0 if r[p] < 0.05 else -1)
    if name == "group_tests_two":
        assert [r["mean_diff"] for r in rows] == sorted((r["mean_diff"] for r in rows), reverse=True)


def test_pearson_p(spark):
    n = td.segments(spark, SF_SMALL).count()
    for r in run(spark, "pearson_p"):
        row = r.asDict()
        t = row.get("t")
        assert 0 <= row["p"] <= 1
        if t is not None:
            df = row.get("df") or (row["n"] - 2 if "n" in row else n - 2)
            assert row["p"] == pytest.approx(2 * tail(t_density(df), abs(t)), abs=2e-3)


def test_sweep_fits_models_of_full_size(spark, monkeypatch):
    """No model of the sweep is smaller than its family: rounds, trees, units and steps."""
    asked = {}
    monkeypatch.setattr(mq, "run_models", lambda s, d, names, **over: asked.update(names=list(names), over=over))
    mq.model_sweep(spark, SF_SMALL)
    assert sorted(asked["names"]) == sorted(ml.REG_MODELS + ml.CLS_MODELS)
    made = {n: ml.estimator(n, 7, 5, **dict(asked["over"].get(n, {}))) for n in asked["names"]}
    for n in ("GDBreg", "XGBreg"):
        assert made[n].getMaxIter() == ml.BOOSTING[n[:3]]["maxIter"] == 100
    for n in ("GDBcls", "XGBcls"):
        assert made[n].getClassifier().getMaxIter() == 100
    for n in ("RFreg", "RFcls"):
        assert made[n].getNumTrees() == 100
    for n in ("BAGreg", "BAGcls"):
        assert asked["over"][n]["numTrees"] == 100
    assert made["MLPcls"].getLayers() == [7, 100, 5] and made["MLPcls"].getMaxIter() == 200
    assert made["linearSVM"].most == 1000


def test_smote_samples_are_not_broadcast(spark):
    """Samples, ranks and neighbours grow with the rows: none of them passes through the driver, however small they look."""
    import re

    from segstats.operators import sampling as sp

    rows = [(i, "a" if i < 60 else "b", float(i % 7), float(i * i % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, f"{KEY} long, y string, p double, q double")
    out = sp.smote(df, "y", ["p", "q"], k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.findall(r"BroadcastHashJoin \[[^]]*(?:rank#|__a#|__j#)", plan)
    assert sorted(r["count"] for r in out.groupBy("y").count().collect()) == [60, 60]
