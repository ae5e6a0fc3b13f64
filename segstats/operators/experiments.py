"""Experiment runs: execute a plan of (seed, feature set, selection, resampling,
model) combinations and append one scored row each to a result table.

The plan is a table (``reports.run_plan``); only its rows (parameters, no data)
reach the driver. Data preparation is shared by the runs that differ in the
model alone: split by seed, selection and scaling fitted on train, resampling of
train. Runs already in the result table are left out, so an interrupted
experiment resumes and a repeated one adds nothing.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round
from segstats.operators import models as ml
from segstats.operators import reports as rp
from segstats.operators import sampling as sp
from segstats.operators import scaling as sc
from segstats.session import cut_lineage, path_exists

KEY = "index_seg"
RUN_KEYS = ["model_name", "ftr_combo_name", "feature_selection", "upsample", "seed"]
SCHEMA = ("kind string, model_name string, ftr_combo_name string, feature_selection string, upsample string, seed long, "
          "n_features int, n_train long, n_test long, test_f1_micro double, test_f1_macro double, test_f1_weighted double, "
          "train_f1_micro double, test_mse double, skipped string")


def select_features(train: DataFrame, cols: list[str], how: str, target: str) -> list[str]:
    """'' keeps all; 'variance' those with population variance > 0.01 after min-max
    scaling; 'mrmr' the half with the best mRMR rank."""
    if how == "":
        return list(cols)
    if how == "variance":
        return sc.variance_select(sc.apply_minmax(train, sc.fit_minmax(train, cols)), cols, 0.01)
    if how == "mrmr":
        ranked = sc.mrmr(train, cols, target, k=max(1, len(cols) // 2)).collect()
        return [r["feature"] for r in sorted(ranked, key=lambda r: r["rank"])]
    raise ValueError(f"unknown selection {how}")


def resample(train: DataFrame, how: str, target: str, cols: list[str], k: int = 5) -> DataFrame | None:
    """Train rows after resampling; None where it is impossible (SMOTE without a
    class of more than k rows below the largest one)."""
    if how == "":
        return train
    if how == "naive":
        return sp.naive_upsample(train, target).drop("copy")
    if how == "under":
        return sp.undersample(train, target, seed=10)
    if how == "smote":
        n = sorted(r["count"] for r in train.groupBy(target).count().collect())  # one row per class
        if not any(k < x < n[-1] for x in n):
            return None
        return sp.smote(train.select(KEY, target, *cols), target, cols, k=k).drop("synthetic")
    raise ValueError(f"unknown resampling {how}")


def run_experiments(plan: DataFrame, data: DataFrame, combos: dict[str, list[str]], path: str,
                    label: str = "csl", lo: float = 1, hi: float = 5, model_options: dict | None = None) -> DataFrame:
    """Runs the pending rows of ``plan`` (RUN_KEYS) over ``data`` (key, label, the
    columns of all ``combos``) and returns the result table at ``path``. Rows
    whose combination cannot run (nothing selected, SMOTE impossible) are
    written with the reason in ``skipped`` and no scores."""
    spark = data.sparkSession
    options = model_options or {}
    plan = plan.withColumn("seed", F.col("seed").cast("long"))
    if path_exists(spark, path):
        plan = rp.pending_runs(plan, spark.read.schema(SCHEMA).parquet(path), RUN_KEYS)
    groups = defaultdict(list)
    for r in plan.select(*RUN_KEYS).distinct().collect():
        groups[r["seed"], r["ftr_combo_name"], r["feature_selection"], r["upsample"]].append(r["model_name"])
    every, parted = list(dict.fromkeys(c for _, combo, _, _ in groups for c in combos[combo])), {}
    for (seed, combo, how, up), names in sorted(groups.items()):
        cols = combos[combo]
        if seed not in parted:  # the split is the same for all runs of a seed: written once, with the columns of all of them
            x = data.select(KEY, label, *every).withColumn("__cls", bounded_round(label, lo, hi).cast("double"))
            parted = {seed: cut_lineage(x.join(sp.split_80_20(x.select(KEY), int(seed)), KEY))}
        x = parted[seed].select(KEY, label, *cols, "__cls", "part")
        train, test = x.filter("part = 'train'"), x.filter("part = 'test'")
        kept = select_features(train, cols, how, "__cls")
        rows, skipped = [], None if kept else "nothing selected"
        n_test = test.count()
        if kept:
            fitted = sc.fit_minmax(train, kept)
            train, test = (sc.apply_minmax(d, fitted) for d in (train, test))
        for kind in ("reg", "cls"):
            mine = sorted(n for n in names if ml.kind_of(n) == kind)
            if not mine:
                continue
            target = label if kind == "reg" else "__cls"
            base = train.withColumn("__bin", F.col("__cls"))
            tr = None if skipped else resample(base if up != "smote" else base.select(KEY, "__bin", target, *kept), up, "__bin",
                                               kept if kind == "cls" else [*kept, target])
            if tr is not None:
                tr = cut_lineage(tr.withColumn("label", F.col("__bin" if kind == "cls" else target)))
            rows += [_run(kind, n, tr, test.withColumn("label", F.col(target)), kept, lo, hi, options.get(n, {}),
                          skipped or "resampling impossible", (combo, how, up, seed), n_test) for n in mine]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _run(kind, name, train, test, cols, lo, hi, options, reason, run, n_test) -> tuple:
    combo, how, up, seed = run
    if train is None:
        return (kind, name, combo, how, up, seed, len(cols), None, None, None, None, None, None, None, reason)
    model = ml.fit(name, train, cols, n_classes=int(hi - lo) + 3, **options)
    on_test = ml.evaluate(model.transform(test), kind, lo, hi).first()
    on_train = ml.evaluate(model.transform(train), kind, lo, hi).first()
    return (kind, name, combo, how, up, seed, len(cols), train.count(), n_test, on_test["f1_micro"], on_test["f1_macro"],
            on_test["f1_weighted"], on_train["f1_micro"], on_test["mse"], None)
