"""Shared-pass linear SVMs against Newton steps on one machine, and elimination against refits from scratch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators import models as ml
from segstats.operators import svm

COLS = ["a", "b", "c", "d"]


def newton(x, y, c=1.0):
    x, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        on = y * (x @ w) < 1
        g = w - 2 * c * x[on].T @ (y[on] - x[on] @ w)
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * x[on].T @ x[on], g)
        f = lambda v: v @ v / 2 + c * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        t = 1.0
        while f(w - t * step) > f(w) - 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        w = w - t * step
        if np.abs(g).max() < 1e-9:
            break
    return w


def by_hand(x, y, train, kept):
    """Weights of every class on the kept columns, zero elsewhere."""
    out = np.zeros((len(set(y)), x.shape[1] + 1))
    for k in range(len(out)):
        out[k, [*kept, -1]] = newton(x[train][:, kept], np.where(y[train] == k, 1.0, -1.0))
    return out


def path_by_hand(x, y, train):
    kept, out = list(range(x.shape[1])), []
    while True:
        w = by_hand(x, y, train, kept)
        test = ~train
        right = ((np.column_stack((x, np.ones(len(x)))) @ w.T).argmax(1) == y)[test].mean() if test.any() else None
        out.append((list(kept), right))
        if len(kept) == 1:
            return out
        weight = (w[:, :-1] ** 2).sum(0)
        kept.remove(min(kept, key=lambda j: (weight[j], -j)))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.random((240, 4)) * [1, 10, 1, 0.1]
    y = np.digitize(x[:, 0] + x[:, 1] / 10 + 0.2 * rng.normal(size=240), [0.6, 1.3])
    fold = rng.integers(0, 3, 240)
    rows = [(*map(float, v), float(t) + 1, int(f)) for v, t, f in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label double, fold int").repartition(3)
    return x, y, fold, df


def test_fit_equals_newton(data):
    x, y, _, df = data
    table, classes = svm.training_table(df, COLS, "label")
    w = svm.fit(table, len(classes), 5)
    assert classes == [1.0, 2.0, 3.0] and w == pytest.approx(by_hand(x, y, np.ones(240, bool), [0, 1, 2, 3]), abs=1e-3)
    got = df.select(*COLS, svm.decision(COLS, w).alias("m")).collect()
    for r in got[:20]:
        assert r.m == pytest.approx((w @ [r.a, r.b, r.c, r.d, 1]).tolist())


def test_elimination_equals_refits(data):
    x, y, fold, df = data
    path, scores = svm.eliminate(df, COLS, "label", "fold")
    assert path == [[COLS[j] for j in kept] for kept, _ in path_by_hand(x, y, np.ones(240, bool))]
    want = {}
    for f in range(3):
        for kept, right in path_by_hand(x, y, fold != f):
            want.setdefault(len(kept), []).append(right)
    assert {k: sorted(v) for k, v in scores.items()} == {k: pytest.approx(sorted(v)) for k, v in want.items()}
    chosen, table = ml.rfecv("linearSVM", df, COLS, "fold")
    means = {k: np.mean(v) for k, v in want.items()}
    assert chosen == path[4 - max(means, key=lambda k: (means[k], k))]
    assert {r.n_features: r.cv_accuracy for r in table.collect()} == pytest.approx(means)


def test_awkward_rows(spark):
    rows = [(None, 1.0, "x", 0), (float("nan"), 2.0, "x", 1), (3.0, None, "y", 0), (4.0, 1.0, "y", None), (5.0, 5.0, None, 1)]
    df = spark.createDataFrame(rows, "a double, b double, label string, fold int")
    path, scores = svm.eliminate(df, ["a", "b"], "label", "fold")
    assert [len(p) for p in path] == [2, 1] and set(scores) == {1, 2} and all(len(v) == 2 for v in scores.values())
    none = svm.eliminate(df.filter(F.lit(False)), ["a", "b"], "label", "fold")
    assert none == ([], {})


def test_few_passes_for_all_problems(data, monkeypatch):
    """Folds, classes and sizes share the passes: their number is that of the longest path."""
    passes, real = [], svm.sums
    monkeypatch.setattr(svm, "sums", lambda *a: passes.append(len(a[2])) or real(*a))
    svm.eliminate(data[3], COLS, "label", "fold")
    assert passes[0] == 4 and len(passes) < 100


def test_a_pass_reads_packed_blocks(data, monkeypatch):
    """Every task gives back one row of sums over blocks of rows; their cut changes nothing."""
    df = data[3]
    table, classes = svm.training_table(df, COLS, "label", "fold")
    w = np.random.default_rng(0).normal(size=(2, len(classes), 5))
    want = svm.sums(svm.packed(table, 5), w, [None, 1])
    monkeypatch.setattr(svm, "BLOCK", 35)
    monkeypatch.setattr(svm, "TASK", 300)
    blocks = svm.packed(table, 5)
    assert blocks.count() >= 240 / 7 and blocks.inputFiles() and len(blocks.inputFiles()) == 4
    for a, b in zip(svm.sums(blocks, w, [None, 1]), want):
        assert a == pytest.approx(b)
    assert want[2][0].sum() == 0 and want[2][1].sum() == (data[2] == 1).sum()


def test_kernel_features_are_dealt_to_tasks(data, monkeypatch):
    df = data[3].withColumn("id", F.monotonically_increasing_id()).coalesce(1)
    want = {r.id: r.margin for r in svm.margin_rows(df, COLS, "label", "id", n=16).collect()}
    written, real = [], svm.cut_lineage
    monkeypatch.setattr("segstats.session.TASK_ROWS", 640)
    monkeypatch.setattr(svm, "cut_lineage", lambda df: written.append(df.rdd.getNumPartitions()) or real(df))
    got = {r.id: r.margin for r in svm.margin_rows(df, COLS, "label", "id", n=16).collect()}
    assert written[0] == 6 and got == pytest.approx(want, abs=1e-4)
