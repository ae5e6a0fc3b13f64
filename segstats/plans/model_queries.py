"""Model queries (rows-only checks: model fits are not SQL-expressible).

Data: the assembled feature matrix joined with the mean-rating label, split
80/20 with seed 0, min-max scaled on train. Regression targets the rating,
classification its bounded class.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round, portable_hash_sql
from segstats.operators import experiments as ex
from segstats.operators import models as ml
from segstats.operators import reports as rp
from segstats.operators import sampling as sp
from segstats.operators import scaling as sc
from segstats.operators import svm
from segstats.plans.feature_queries import assemble
from segstats.plans.label_queries import SPLIT_SEEDS
from segstats.plans.registry import query
from segstats.session import cut_lineage, ensure_checkpoint_dir
from segstats.sources import testdata as td

KEY = td.KEY
COLS = ["orders_F", "orders_O", "orders_P", "qty_A", "qty_N", "qty_R", "acctbal"]
N_CLASSES = 7  # bounded classes 0..6
# sizes of the models of a sweep; a model that is not named has the size ``ml.estimator`` gives it
SWEEP = {**{n: {"numTrees": 100} for n in ("RFreg", "RFcls", "BAGreg", "BAGcls")}, "MLPcls": {"maxIter": 200}, "linearSVM": {"maxIter": 1000}}


def labelled_rows(spark, d):
    x = assemble(spark, d).join(td.labels(spark, d), KEY)
    return x.withColumn("y_cls", bounded_round("csl", 1, 5).cast("double"))


def model_data(spark, d, seed: int = 0, rows=None):
    """Train and test rows of a seed; ``rows``: the ``labelled_rows``, if several seeds share them."""
    x = labelled_rows(spark, d) if rows is None else rows
    split = sp.split_80_20(x.select(KEY), seed)
    x = x.join(split, KEY)
    fitted = sc.fit_minmax(x.filter(F.col("part") == "train"), COLS)
    # iterative learners scan their input many times: give them a small
    # materialised table instead of the feature-assembly lineage
    x = cut_lineage(sc.apply_minmax(x, fitted))
    return x.filter(F.col("part") == "train"), x.filter(F.col("part") == "test")


def run_models(spark, d, names, **over):
    train, test = model_data(spark, d)
    out = None
    for name in names:
        kind = ml.kind_of(name)
        y = "csl" if kind == "reg" else "y_cls"
        tr, te = train.withColumn("label", F.col(y)), test.withColumn("label", F.col(y))
        model = ml.fit(name, tr, COLS, n_classes=N_CLASSES, **over.get(name, {}))
        row = ml.evaluate(model.transform(te), kind).select(
            F.lit(kind).alias("kind"), F.lit(name).alias("model_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("train_m1")
def train_m1(spark, d):
    """M1: ordinary least squares, scored ordinally on the test split."""
    return run_models(spark, d, ["ols"])


@query("train_m2")
def train_m2(spark, d):
    """M2: ridge regression."""
    return run_models(spark, d, ["ridge"])


@query("train_m3")
def train_m3(spark, d):
    """M3: lasso regression."""
    return run_models(spark, d, ["lasso"])


@query("train_m4")
def train_m4(spark, d):
    """M4: decision trees (regressor and classifier)."""
    return run_models(spark, d, ["DTreg", "DTcls"], DTreg={"maxDepth": 5}, DTcls={"maxDepth": 5})


@query("train_m5")
def train_m5(spark, d):
    """M5: random forests (regressor and classifier)."""
    return run_models(spark, d, ["RFreg", "RFcls"], RFreg={"numTrees": 100}, RFcls={"numTrees": 100})


@query("train_m6")
def train_m6(spark, d):
    """M6: bagging (random forest over all features per split)."""
    return run_models(spark, d, ["BAGreg", "BAGcls"], BAGreg={"numTrees": 100}, BAGcls={"numTrees": 100})


@query("train_m7")
def train_m7(spark, d):
    """M7: gradient boosting, both families (regressors; one-vs-rest classifiers)."""
    fewer = {"maxIter": 20}  # rounds: a parameter of the run, the default is 100
    return run_models(spark, d, ["GDBreg", "XGBreg", "GDBcls", "XGBcls"], GDBreg=fewer, XGBreg=fewer, GDBcls=fewer, XGBcls=fewer)


@query("train_m8")
def train_m8(spark, d):
    """M8: multinomial logistic regression."""
    return run_models(spark, d, ["logistics"])


@query("train_m9")
def train_m9(spark, d):
    """M9: linear SVM (one-vs-rest)."""
    return run_models(spark, d, ["linearSVM"], linearSVM={"maxIter": 20})


@query("train_m10")
def train_m10(spark, d):
    """Multilayer perceptron classifier."""
    return run_models(spark, d, ["MLPcls"], MLPcls={"hidden": [20], "maxIter": 100})


@query("grid_search")
def grid_search(spark, d):
    """5-fold grid search of ridge and of linear SVM over their whole grids;
    the table of mean CV metric (MSE, weighted F1) per parameter map, best first."""
    train, _ = model_data(spark, d)
    folds = sp.k_fold(train.select(KEY), seed=1, k=5)
    tr = cut_lineage(train.join(folds, KEY))
    _, ridge = ml.grid_search("ridge", tr.withColumn("label", F.col("csl")), COLS, parallelism=8)
    _, machine = ml.grid_search("linearSVM", tr.withColumn("label", F.col("y_cls")), COLS, parallelism=8)
    return ridge.unionByName(machine)


@query("grid_search_stored")
def grid_search_stored(spark, d):
    """M12 + A10: a stored grid search of lasso; the second call reads the best parameters and fits them alone."""
    train, _ = model_data(spark, d)
    tr = cut_lineage(train.join(sp.k_fold(train.select(KEY), seed=1, k=5), KEY).withColumn("label", F.col("csl")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grid-{uuid.uuid4().hex}"
    ml.stored_grid_search("lasso", tr, COLS, path)
    _, table = ml.stored_grid_search("lasso", tr, COLS, path)
    return table.select("place", "model_name", "params", "cv_metric")


@query("train_naive_bayes")
def train_naive_bayes(spark, d):
    """Gaussian naive Bayes, scored on the test split."""
    return run_models(spark, d, ["GNBcls"])


@query("model_sweep")
def model_sweep(spark, d):
    """All sixteen models in speed order, one result row each, every model at its full size: boosting with the
    rounds of its family, forests of 100 trees, a hidden layer of 100 units, machines that run until they stop."""
    return run_models(spark, d, ml.SPEED_ORDER, **SWEEP)


COMBOS = {"orders": ["orders_F", "orders_O", "orders_P"], "orders+items+account": COLS}


def experiment_rows(spark, d):
    return cut_lineage(assemble(spark, d).join(td.labels(spark, d), KEY))


def experiment(spark, x, path):
    """A plan of 32 runs over ``x``, the matrix and the label, executed into ``path``."""
    plan = rp.run_plan({"seed": [0, 100], "ftr_combo_name": list(COMBOS), "feature_selection": ["", "variance"],
                        "upsample": ["", "naive"], "model_name": ["ridge", "DTcls"]}, spark=spark)
    return ex.run_experiments(plan, x, COMBOS, path, model_options={"DTcls": {"maxDepth": 5}})


@query("run_experiments")
def run_experiments(spark, d):
    """The plan's runs executed into a result table (one scored row each); the
    same plan again adds nothing."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/experiment-{uuid.uuid4().hex}"
    x = experiment_rows(spark, d)
    experiment(spark, x, path)
    return experiment(spark, x, path)


@query("experiment_best")
def experiment_best(spark, d):
    """M14 + H2 + H10: means over seeds of the executed runs and the best models of
    each selection scheme."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/experiment-{uuid.uuid4().hex}"
    r = experiment(spark, experiment_rows(spark, d), path).filter("skipped is null")
    means = r.groupBy("feature_selection", "model_name", "ftr_combo_name").agg(F.avg("test_f1_weighted").alias("test_f1_weighted"))
    return rp.best_per_scheme(means, "feature_selection", ["model_name", "ftr_combo_name"], "test_f1_weighted", 2)


@query("score_population")
def score_population(spark, d):
    """A classifier fitted on the labelled segments scores every segment of the
    population: prediction, class probabilities, their maximum and the true class
    (null where a segment has no label)."""
    x = assemble(spark, d)
    lab = td.labels(spark, d).select(KEY, bounded_round("csl", 1, 5).cast("double").alias("y_cls"))
    x = cut_lineage(x.join(lab, KEY, "left"))
    known = x.filter(F.col("y_cls").isNotNull())
    fitted = sc.fit_minmax(known, COLS)
    model = ml.fit("RFcls", sc.apply_minmax(known, fitted).withColumn("label", F.col("y_cls")), COLS, numTrees=100)
    return ml.score_population(model, sc.apply_minmax(x, fitted).withColumn("label", F.coalesce("y_cls", F.lit(0.0))), KEY, truth="y_cls")


@query("oof_predictions")
def oof_predictions(spark, d):
    """Out-of-fold predictions over a shuffled 5-fold split."""
    train, test = model_data(spark, d)
    allx = train.unionByName(test).withColumn("label", F.col("y_cls"))
    folds = sp.k_fold(allx.select(KEY), seed=7, k=5)
    allx = allx.join(folds, KEY)
    out = None
    for k in range(5):
        m = ml.fit("DTcls", allx.filter(F.col("fold") != k), COLS, maxDepth=5)
        p = m.transform(allx.filter(F.col("fold") == k)).select(KEY, "fold", "label", "prediction")
        out = p if out is None else out.unionByName(p)
    return out


@query("importance_summary")
def importance_summary(spark, d):
    """Random-forest importances per seed (with the population std
    over trees), then mean and sample std over seeds per feature."""
    rows, x = [], cut_lineage(labelled_rows(spark, d))  # the features are assembled once for all seeds
    for seed in SPLIT_SEEDS:
        train, _ = model_data(spark, d, seed, x)
        m = ml.fit("RFreg", train.withColumn("label", F.col("csl")), COLS, seed=seed, numTrees=20)
        rows += [(seed, f, imp, sd) for f, imp, sd in ml.importances(m.stages[-1], COLS)]
    long = spark.createDataFrame(rows, "seed int, feature string, importance double, tree_std double")
    return long.groupBy("feature").agg(F.avg("importance").alias("importance_mean"),
                                       F.stddev_samp("importance").alias("importance_std"),
                                       F.avg("tree_std").alias("tree_std"))


def smote_input(spark, d):
    """Unscaled train rows (resampling comes before scaling, as in the
    reference) with the rounded class."""
    x = assemble(spark, d).join(td.labels(spark, d).hint("merge"), KEY)
    x = x.withColumn("y_cls", F.bround("csl", 0))
    split = sp.split_80_20(x.select(KEY), 0)
    return x.join(split.hint("merge"), KEY).filter(F.col("part") == "train").select(KEY, "y_cls", *COLS)


@query("smote_regular")
def smote_regular(spark, d):
    """SMOTE top-up of every class to the majority size (rows)."""
    return sp.smote(smote_input(spark, d), "y_cls", COLS, seed=10, k=5, grid=("acctbal", "qty_A"))


_SMOTE_COUNTS = f"""
WITH x AS (SELECT o_custkey AS index_seg, round_even(avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)), 0) AS y_cls
           FROM orders GROUP BY 1),
r AS (SELECT x.*, row_number() OVER (ORDER BY {portable_hash_sql('index_seg', '0')},
                                      index_seg) AS rk, count(*) OVER () AS n
      FROM x JOIN customer c ON x.index_seg = c.c_custkey),
t AS (SELECT * FROM r WHERE rk > ceil(0.2::DOUBLE * n)),
c AS (SELECT y_cls, count(*) AS n FROM t GROUP BY 1)
SELECT y_cls, CASE WHEN n > 5 THEN (SELECT max(n) FROM c) ELSE n END AS n FROM c
"""


@query("smote_class_counts", sql=_SMOTE_COUNTS)
def smote_class_counts(spark, d):
    """Class sizes after SMOTE (classes with more than k rows reach the
    majority size)."""
    s = sp.smote(smote_input(spark, d), "y_cls", COLS, seed=10, k=5, grid=("acctbal", "qty_A"))
    return s.groupBy("y_cls").agg(F.count(F.lit(1)).alias("n"))


@query("smote_margin")
def smote_margin(spark, d):
    """SMOTE seeded by the rows on or inside their class's margin under a Gaussian-kernel
    machine (random Fourier features). Columns are min-max scaled for the fit only."""
    x = cut_lineage(smote_input(spark, d))
    scaled = sc.apply_minmax(x, sc.fit_minmax(x, COLS))
    seeds = svm.margin_rows(scaled, COLS, "y_cls", KEY).select(KEY, F.lit(True).alias("__sv"))
    flag = x.join(seeds.hint("merge"), KEY, "left")
    return sp.smote(flag, "y_cls", COLS, seed=10, k=5, seeds_filter=F.col("__sv").isNotNull())


@query("smote_before_split")
def smote_before_split(spark, d):
    """SMOTE on all rows, then the 80/20 split of the resampled table (synthetic
    rows included, so it leaks: an option kept because experiments use it).
    Synthetic rows get ids after the largest original one."""
    x = assemble(spark, d).join(td.labels(spark, d), KEY).withColumn("y_cls", F.bround("csl", 0))
    s = sp.smote(x.select(KEY, "y_cls", *COLS), "y_cls", COLS, seed=10, k=5, grid=("acctbal", "qty_A"))
    s = cut_lineage(s)
    top = s.agg(F.max(KEY)).first()[0] or 0
    new = sp.ordered_position(s.filter("synthetic"), ["y_cls", *COLS]).withColumn(KEY, F.col("position") + top + 1).drop("position")
    s = cut_lineage(s.filter("not synthetic").unionByName(new))
    return s.join(sp.split_80_20(s.select(KEY), 0), KEY)


_BIN_COLS = ["orders_F", "orders_O", "orders_P", "qty_A", "qty_N", "qty_R", "acctbal"]


@query("mrmr_rank")
def mrmr_rank(spark, d):
    """Greedy mRMR ranking of the matrix columns against the class
    (10 equal-width bins)."""
    train, _ = model_data(spark, d)
    return sc.mrmr(train, _BIN_COLS, "y_cls", k=4, bins=10)


@query("variance_mask")
def variance_mask(spark, d):
    """C7 + C10: the variance selector fitted on train and its column mask
    applied to train and test alike."""
    train, test = model_data(spark, d)
    kept = sc.variance_select(train, COLS, 0.01)
    return train.unionByName(test).select(KEY, "part", *kept)


@query("rfecv_linsvc")
def rfecv_linsvc(spark, d):
    """Recursive elimination with a linear SVM (one-vs-rest) down to one column,
    scored by 5-fold stratified cross-validation; the mean CV accuracy per subset
    size and the chosen columns."""
    train, _ = model_data(spark, d)
    folds = sp.stratified_folds(train.select(KEY, "y_cls"), "y_cls", seed=3, k=5).select(KEY, "fold")
    tr = cut_lineage(train.join(folds, KEY).withColumn("label", F.col("y_cls")))
    chosen, table = ml.rfecv("linearSVM", tr, COLS, "fold", min_features=1)
    return table.withColumn("chosen", F.lit(",".join(chosen)))


@query("neighbour_columns_selected")
def neighbour_columns_selected(spark, d):
    """B11 + G14: the neighbour-average columns of the features whose Moran's
    I is significant, joined to the features (self + selected neighbours)."""
    from segstats.operators.spatial import lag
    from segstats.operators.spatial import moran as mo
    from segstats.plans.spatial_queries import BANDS, FEATS, _band_moran

    sig = [r["column"] for r in mo.select_columns(_band_moran(spark, d, BANDS, FEATS), BANDS[0], 0.0)
           .select("column").collect()]
    p = td.point_features(spark, d, 4)
    nb = lag.band_neighbour_mean(p, BANDS[0], FEATS)
    keep = [c + lag.SUFFIX for c in FEATS if c in sig and c + lag.SUFFIX in nb.columns]
    return p.select("id", *FEATS).join(nb.select("id", *keep), "id", "left")
