"""Model training, grid search and scoring with Spark ML.

The reference's model families are mapped to Spark ML estimators (documented
differences: regularisation scales, multiclass boosting runs one-vs-rest; linear SVMs and least-squares
grids have their own shared passes). Training data stays in
Spark; only model coefficients / importances (p numbers) reach the driver.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators import metrics as mt
from segstats.operators import bagging, linear, svm
from segstats.session import path_exists

FEATURES = "features"
LABEL = "label"

# Model names grouped by kind (regression / classification).
REG_MODELS = ["ols", "ridge", "lasso", "DTreg", "RFreg", "BAGreg", "GDBreg", "XGBreg"]
CLS_MODELS = ["logistics", "DTcls", "RFcls", "BAGcls", "GDBcls", "XGBcls", "linearSVM", "MLPcls"]
# Slow-first ordering is irrelevant on a cluster; fast-first keeps feedback early.
SPEED_ORDER = ["ols", "ridge", "lasso", "logistics", "DTreg", "DTcls", "linearSVM", "RFreg", "RFcls",
               "BAGreg", "BAGcls", "MLPcls", "GDBreg", "GDBcls", "XGBreg", "XGBcls"]


# Defaults of the two boosting families (Spark ML has one boosting learner).
BOOSTING = {"GDB": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
            "XGB": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6}}
# Spark ML's limits: trees are at most 30 levels deep, steps at most 1 (larger grid values are cut to them)
MAX_DEPTH, MAX_STEP = 30, 1.0


def kind_of(name: str) -> str:
    return "reg" if name in REG_MODELS else "cls"


def estimator(name: str, n_features: int | None = None, n_classes: int | None = None, seed: int = 0, **over):
    """Default estimator for a reference model name."""
    if name == "ols":
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0, **over)
    if name == "ridge":
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, **{"elasticNetParam": 0.0, "regParam": 1.0, **over})
    if name == "lasso":
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, **{"elasticNetParam": 1.0, "regParam": 1.0, **over})
    if name in ("DTreg", "DTcls") and "featureSubsetStrategy" in over:  # a tree that draws columns at each split: a forest of one
        forest = RandomForestRegressor if name == "DTreg" else RandomForestClassifier
        return forest(featuresCol=FEATURES, labelCol=LABEL, seed=seed, numTrees=1, bootstrap=False, **over)
    if name == "GNBcls":
        return NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian", **over)
    if name == "DTreg":
        return DecisionTreeRegressor(featuresCol=FEATURES, labelCol=LABEL, seed=seed, **over)
    if name == "RFreg":
        return RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, seed=seed, **over)
    if name == "BAGreg":
        return bagging.BaggedTrees("reg", FEATURES, LABEL, seed=seed, **over)
    if name in ("GDBreg", "XGBreg"):
        return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, seed=seed, **{**BOOSTING[name[:3]], **over})
    if name == "logistics":
        return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, family="multinomial", **over)
    if name == "DTcls":
        return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, seed=seed, **over)
    if name == "RFcls":
        return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, seed=seed, **over)
    if name == "BAGcls":
        return bagging.BaggedTrees("cls", FEATURES, LABEL, seed=seed, **over)
    if name in ("GDBcls", "XGBcls"):
        return OneVsRest(classifier=GBTClassifier(seed=seed, **{**BOOSTING[name[:3]], **over}), featuresCol=FEATURES, labelCol=LABEL,
                         parallelism=4)
    if name == "linearSVM":
        return svm.SvmClassifier(**over)
    if name == "MLPcls":
        hidden = over.pop("hidden", [100])
        return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL, seed=seed,
                                              layers=[n_features, *hidden, n_classes], **over)
    raise ValueError(f"unknown model {name}")


# regParam and elasticNetParam of the least-squares models
LEAST_SQUARES = {"ols": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (1.0, 1.0)}
# Hyperparameter grids (by model family; depth and step beyond Spark ML's limits are cut).
LOGSPACE = [10 ** (2 * i / 9) for i in range(10)]
GRIDS = {
    "ridge": {"regParam": LOGSPACE},
    "lasso": {"regParam": LOGSPACE},
    "DTreg": {"maxDepth": [3, 5, 10, 30, 50], "featureSubsetStrategy": ["0.1", "0.3", "0.5", "1.0"]},
    "DTcls": {"maxDepth": [3, 5, 10, 30, 50], "featureSubsetStrategy": ["0.1", "0.3", "0.5", "1.0"], "impurity": ["gini", "entropy"]},
    "RFreg": {"numTrees": [10, 100, 500], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2]},
    "RFcls": {"numTrees": [10, 100, 500], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2]},
    "BAGreg": {"numTrees": [10, 30, 50, 100, 256, 500], "maxFeatures": [0.4, 0.7, 1.0]},
    "BAGcls": {"numTrees": [10, 30, 50, 100, 256, 500], "maxFeatures": [0.4, 0.7, 1.0]},
    "GDBreg": {"maxIter": [10, 50, 100], "featureSubsetStrategy": ["sqrt", "log2"], "stepSize": [1e-4, 10 ** -1.5, 10.0], "maxDepth": [3, 10, 50]},
    "GDBcls": {"maxIter": [10, 50, 100], "featureSubsetStrategy": ["sqrt", "log2"], "stepSize": [1e-4, 10 ** -1.5, 10.0], "maxDepth": [3, 10, 50]},
    "XGBreg": {"maxIter": [500], "stepSize": [0.01, 0.05, 0.1, 0.3], "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [1, 5],
               "minInfoGain": [0.0, 0.1], "featureSubsetStrategy": ["0.7", "1.0"]},
    "XGBcls": {"maxIter": [500], "stepSize": [0.01, 0.05, 0.1, 0.3], "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [1, 5],
               "minInfoGain": [0.0, 0.1], "featureSubsetStrategy": ["0.7", "1.0"]},
    "logistics": {"regParam": [1e4, 1e2, 1.0, 1e-2], "elasticNetParam": [0.0, 1.0]},
    "linearSVM": {"C": [1e-4, 1e-1, 1e2]},
    "MLPcls": {"hidden": [(100,), (5, 2), (20, 5), (100, 20), (100, 20, 5)], "maxIter": [10000]},
}


def param_grid(name: str) -> list[dict]:
    """Every combination of the model's grid as keyword arguments of ``estimator``."""
    from itertools import product

    grid = {k: list(dict.fromkeys(min(v, {"maxDepth": MAX_DEPTH, "stepSize": MAX_STEP}.get(k, v)) if isinstance(v, (int, float)) else v
                                  for v in vs)) for k, vs in GRIDS.get(name, {}).items()}
    return [dict(zip(grid, x)) for x in product(*grid.values())]


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep").transform(df)


def fit(name: str, train: DataFrame, cols: list[str], n_classes: int | None = None, seed: int = 0, **over):
    """Fit a pipeline: assemble features, then the estimator. Classifiers train
    on contiguous label indices (StringIndexer) so one-vs-rest never meets an
    empty class; ``prediction`` is mapped back to the original label value."""
    stages = [VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep")]
    if kind_of(name) == "reg":
        stages.append(estimator(name, len(cols), n_classes, seed, **over))
        return Pipeline(stages=stages).fit(train)
    indexer = StringIndexer(inputCol=LABEL, outputCol="__label_idx", stringOrderType="alphabetAsc")
    idx_model = indexer.fit(train)
    k = len(idx_model.labels)
    est = estimator(name, len(cols), k, seed, **over)
    est.setLabelCol("__label_idx").setPredictionCol("__pred_idx")
    back = IndexToString(inputCol="__pred_idx", outputCol="__pred_label", labels=idx_model.labels)
    cast = SQLTransformer(statement="SELECT *, CAST(__pred_label AS DOUBLE) AS prediction FROM __THIS__")
    return Pipeline(stages=[*stages, idx_model, est, back, cast]).fit(train)


def grid_search(name: str, train: DataFrame, cols: list[str], fold_col: str = "fold", n_classes: int | None = None,
                parallelism: int = 4, seed: int = 0, grid: list[dict] | None = None):
    """k-fold grid search on a precomputed fold column (stratified for
    classifiers); best by weighted F1 (classification) or MSE (regression).
    Least squares takes one pass for all folds and penalties, linear SVMs share the
    passes of all folds, classes and penalties; other models are independent fits,
    run ``parallelism`` at a time.
    Returns (best pipeline fitted on all rows, table of mean CV metric per
    parameter map, best first)."""
    grid = param_grid(name) if grid is None else grid
    cls = kind_of(name) == "cls"
    if name in LEAST_SQUARES:
        means = linear.grid_mse(train, cols, LABEL, fold_col, [
            (p.get("regParam", LEAST_SQUARES[name][0]), p.get("elasticNetParam", LEAST_SQUARES[name][1])) for p in grid])
    elif name == "linearSVM" and all(set(p) <= {"C"} for p in grid):
        means = svm.grid_f1(train, cols, LABEL, fold_col, [p.get("C", 1.0) for p in grid])
    else:
        means = fitted_means(name, train, cols, fold_col, n_classes, parallelism, seed, grid)
    order = sorted(range(len(grid)), key=lambda i: (-means[i] if cls else means[i], i))
    table = train.sparkSession.createDataFrame([(name, str(grid[i]), float(means[i])) for i in order],
                                               "model_name string, params string, cv_metric double")
    return fit(name, train, cols, n_classes, seed, **grid[order[0]]), table


def stored_grid_search(name: str, train: DataFrame, cols: list[str], path: str, fold_col: str = "fold", redo: bool = False, **options):
    """``grid_search`` whose table is written to ``path``; if it is there already (and not
    ``redo``), the best parameters are read from it and only the best model is fitted."""
    spark = train.sparkSession
    if path_exists(spark, path) and not redo:
        table = spark.read.parquet(path)
        best = table.orderBy("place").first()
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(best["params_json"]).items()}
        return fit(name, train, cols, options.get("n_classes"), options.get("seed", 0), **params), table
    grid = options.pop("grid", None) or param_grid(name)
    model, found = grid_search(name, train, cols, fold_col, grid=grid, **options)
    rows = [(i, r["model_name"], r["params"], json.dumps(next(p for p in grid if str(p) == r["params"])), r["cv_metric"])
            for i, r in enumerate(found.collect())]  # one row per parameter map
    spark.createDataFrame(rows, "place int, model_name string, params string, params_json string, cv_metric double").coalesce(1).write.mode(
        "overwrite").parquet(path)
    return model, spark.read.parquet(path)


def fitted_means(name: str, train: DataFrame, cols: list[str], fold_col: str, n_classes: int | None, parallelism: int, seed: int,
                 grid: list[dict]) -> list[float]:
    """Mean CV metric of every parameter map, one fit for each fold and map."""
    from concurrent.futures import ThreadPoolExecutor

    cls = kind_of(name) == "cls"
    ev = (MulticlassClassificationEvaluator(labelCol=LABEL, metricName="f1") if cls
          else RegressionEvaluator(labelCol=LABEL, metricName="mse"))
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())

    def score(job):
        params, f = job
        model = fit(name, train.filter(F.col(fold_col) != f), cols, n_classes, seed, **params)
        return ev.evaluate(model.transform(train.filter(F.col(fold_col) == f)))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        got = list(pool.map(score, [(p, f) for p in grid for f in folds]))
    return [sum(got[i * len(folds):(i + 1) * len(folds)]) / len(folds) for i in range(len(grid))]


def predictions(model, df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Apply a fitted model (pipeline or bare model on assembled features)."""
    x = df if FEATURES in df.columns or cols is None else assemble(df, cols)
    return model.transform(x)


def evaluate(pred: DataFrame, kind: str, lo: float = 1, hi: float = 5, truth: str = LABEL,
             by: list[str] = ()) -> DataFrame:
    """Ordinal scoring: regression outputs are binned with the label binning
    before class metrics; MSE stays on the raw outputs."""
    p = pred.withColumn("__raw", F.col("prediction").cast("double"))
    if kind == "reg":
        p = p.withColumn("__y", mt.bounded_round(truth, lo, hi)).withColumn("__p", mt.bounded_round("__raw", lo, hi))
    else:
        p = p.withColumn("__y", F.col(truth).cast("long")).withColumn("__p", F.col("__raw").cast("long"))
    sc = mt.classification_scores(p, "__y", "__p", by=list(by))
    acc = p.groupBy(*by).agg(F.avg((F.col("__y") == F.col("__p")).cast("double")).alias("accuracy"),
                             F.avg(F.pow(F.col(truth).cast("double") - F.col("__raw"), 2)).alias("mse"))
    return sc.join(acc, list(by)) if by else _one_row_join(sc, acc)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def score_population(model, df: DataFrame, key: str, truth: str | None = None) -> DataFrame:
    """Whole-population scoring: prediction, class probabilities and the
    largest probability per row (classifiers with probabilities)."""
    p = model.transform(df)
    cols = [key, F.col("prediction")]
    if "probability" in p.columns:
        arr = vector_to_array("probability")
        cols += [arr.alias("proba"), F.array_max(arr).alias("max_proba")]
    if truth:
        cols.append(F.col(truth))
    return p.select(*cols)


def importances(model, feature_names: list[str]) -> list[tuple[str, float, float]]:
    """(feature, importance, population std over trees) of a tree ensemble."""
    import math
    imp = model.featureImportances
    imp = (imp if isinstance(model, bagging.BaggedModel) else imp.toArray()).tolist()
    trees = getattr(model, "trees", None) or []
    per_tree = [t.featureImportances.toArray().tolist() for t in trees]
    out = []
    for i, f in enumerate(feature_names):
        if per_tree:
            vals = [t[i] for t in per_tree]
            m = sum(vals) / len(vals)
            sd = math.sqrt(sum((v - m) ** 2 for v in vals) / len(vals))
        else:
            sd = 0.0
        out.append((f, float(imp[i]), float(sd)))
    return out


def linear_importance(model) -> list[float]:
    """Feature weights of a fitted linear model: |coef| (summed over classes
    for multinomial / one-vs-rest models), as recursive elimination ranks them."""
    import numpy as np
    if isinstance(model, svm.SvmModel):
        return np.abs(model.weights[:, :-1]).sum(axis=0).tolist()
    if hasattr(model, "models"):  # one-vs-rest
        return np.sum([np.abs(m.coefficients.toArray()) for m in model.models], axis=0).tolist()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).sum(axis=0).tolist()
    return np.abs(model.coefficients.toArray()).tolist()


def _fit_linear(name: str, train: DataFrame, cols: list[str], **over):
    pipe = fit(name, train, cols, **over)
    est = next(st for st in pipe.stages if hasattr(st, "models") or hasattr(st, "weights") or hasattr(st, "coefficients")
               or hasattr(st, "coefficientMatrix"))
    return pipe, linear_importance(est)


def rfe_path(name: str, train: DataFrame, cols: list[str], min_features: int = 1, **over):
    """Recursive elimination: refit, drop the feature with the smallest
    weight, repeat. Yields (kept columns, fitted pipeline) from all columns
    down to ``min_features``."""
    kept = list(cols)
    while True:
        pipe, imp = _fit_linear(name, train, kept, **over)
        yield list(kept), pipe
        if len(kept) <= min_features:
            return
        drop = min(range(len(kept)), key=lambda i: (imp[i], -i))
        kept.pop(drop)


def rfecv(name: str, train: DataFrame, cols: list[str], fold_col: str = "fold", min_features: int = 1,
          parallelism: int = 4, **over) -> tuple[list[str], DataFrame]:
    """Recursive feature elimination with cross-validation: per fold, the
    elimination path is scored (accuracy) on the held-out fold; the subset
    size with the best mean score (the largest on ties) is then selected by
    elimination on all training rows. Returns (columns, table of
    n_features -> mean CV accuracy). Linear SVMs run all folds, classes and sizes over
    one written table (``svm.eliminate``); other models fit each by itself."""
    from concurrent.futures import ThreadPoolExecutor

    if name == "linearSVM":
        path, scores = svm.eliminate(train, cols, LABEL, fold_col, min_features, over.get("C", 1.0), max_iter=over.get("maxIter", 100))
        return _best_size(train, path, scores)

    folds = [r[0] for r in train.select(fold_col).distinct().collect()]

    def path_scores(f):
        tr, te = train.filter(F.col(fold_col) != f), train.filter(F.col(fold_col) == f)
        out = []
        for kept, pipe in rfe_path(name, tr, cols, min_features, **over):
            acc = pipe.transform(te).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
            out.append((len(kept), float(acc or 0.0)))
        return out

    # folds and the full-data elimination path are independent Spark jobs:
    # submit them concurrently (as CrossValidator does)
    scores: dict[int, list[float]] = {}
    with ThreadPoolExecutor(max_workers=max(1, min(len(folds) + 1, parallelism))) as pool:
        full = pool.submit(lambda: [kept for kept, _ in rfe_path(name, train, cols, min_features, **over)])
        for res in pool.map(path_scores, folds):
            for size, acc in res:
                scores.setdefault(size, []).append(acc)
        path = full.result()
    return _best_size(train, path, scores)


def _best_size(train: DataFrame, path: list[list[str]], scores: dict[int, list[float]]) -> tuple[list[str], DataFrame]:
    """The columns of the size with the best mean score (the largest on ties), and the table of sizes."""
    means = {k: sum(v) / len(v) for k, v in scores.items()}
    best = max(means, key=lambda k: (means[k], k))
    chosen = next(kept for kept in path if len(kept) == best)
    table = train.sparkSession.createDataFrame(sorted(means.items()), "n_features int, cv_accuracy double")
    return chosen, table
