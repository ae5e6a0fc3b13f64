"""Linear support vector machines, many at a time, over one written table.

All problems (one class against the rest, for every group of rows) share the passes: a
pass sends the current weights to the tasks, every task sums loss and gradient of all
problems over its rows with matrix products and gives back one row of problems x columns
numbers. The rows are packed into blocks of numbers once (``packed``), a bounded number of
tasks reads them in every pass. The weights move by L-BFGS with the
diagonal of the curvature as its start; every problem has its own steps and stops by
itself. A pass is one Spark job whatever the number of problems; the driver holds
problems x columns numbers, never rows.

The objective is 1/2 |w|^2 + C * sum(max(0, 1 - y (w x + b))^2) with the intercept among
the weights. Null and NaN features count as 0; rows without a label are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.session import cut_lineage, dealt

PAST = 10  # steps that L-BFGS remembers
BLOCK = 1 << 17  # numbers of a block of rows
TASK, MOST_TASKS = 1 << 19, 256  # numbers that a task of a pass reads, tasks of a pass


def vector_of(cols: list[str]) -> F.Column:
    """The columns as array<double>, null and NaN as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols])


def products(x: F.Column, rows: np.ndarray) -> F.Column:
    """array<double>: the product of ``x`` followed by 1 with every row."""
    lit = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in rows])
    long = F.concat(x, F.array(F.lit(1.0)))
    return F.transform(lit, lambda w: F.aggregate(F.zip_with(long, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def fourier(cols: list[str], n: int = 128, gamma: float | None = None, seed: int = 0) -> F.Column:
    """``n`` random Fourier features (array<double>): inner products of two rows approach the
    Gaussian kernel exp(-gamma * distance^2); ``gamma`` is 1 / columns by default."""
    rng = np.random.default_rng(seed)
    gamma = 1 / len(cols) if gamma is None else gamma
    rows = np.column_stack((rng.normal(size=(n, len(cols))) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)))
    return F.transform(products(vector_of(cols), rows), lambda v: F.cos(v) * float(np.sqrt(2 / n)))


def margin_rows(df: DataFrame, cols: list[str], label: str, id_col: str, kernel: str = "rbf", c: float = 1.0, n: int = 128,
                gamma: float | None = None, seed: int = 0) -> DataFrame:
    """(id, margin) of the rows on or inside the margin of their own class (decision value at most 1)
    under one-against-rest machines: with the kernel ``rbf`` on random Fourier features, with
    ``linear`` on the columns themselves."""
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel: rbf or linear, not {kernel}")
    x = fourier(cols, n, gamma, seed) if kernel == "rbf" else vector_of(cols)
    rows = df.filter(F.col(label).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # one row per class
    if not classes:
        return df.select(id_col, F.lit(0.0).alias("margin")).limit(0)
    number = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(classes) for v in (k, i)]), F.col(label)).cast("int")
    rows = dealt(rows, n if kernel == "rbf" else 1)  # the features are many to a row: one file of rows must not be one task
    table = cut_lineage(rows.select(F.col(id_col).alias("__id"), x.alias("x"), number.alias("y"), F.lit(0).cast("long").alias("g")))
    width = (n if kernel == "rbf" else len(cols)) + 1
    weights = fit(table.select("x", "y", "g"), len(classes), width, c)
    own = F.element_at(products(F.col("x"), weights), F.col("y") + 1)
    return table.select(F.col("__id").alias(id_col), own.alias("margin")).filter(F.col("margin") <= 1)


def training_table(df: DataFrame, cols: list[str], label: str, group: str | None = None) -> tuple[DataFrame, list]:
    """(x array<double>, y class number, g group) as a written table, and the classes in order."""
    rows = df.filter(F.col(label).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # one row per class
    number = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)]), F.col(label)) if classes else F.lit(0)
    x = vector_of(cols)
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    return cut_lineage(rows.select(x.alias("x"), number.cast("int").alias("y"), g.alias("g"))), classes


def packed(table: DataFrame, width: int) -> DataFrame:
    """(x, y, g) of blocks of rows as bytes: what every pass reads. ``table``: x array<double> (``width`` - 1 numbers), y, g."""
    step = max(1, BLOCK // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                x = np.asarray(s.column(0).flatten()).reshape(s.num_rows, width - 1)
                x = np.column_stack((x, np.ones(len(x))))
                y, g = np.asarray(s.column(1).fill_null(-1)).astype(np.int64), np.asarray(s.column(2).fill_null(-1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, g)], ["x", "y", "g"])

    tasks = min(MOST_TASKS, max(1, -(-table.count() * width // TASK)))
    return cut_lineage(table.select("x", "y", "g").repartition(tasks).mapInArrow(run, "x binary, y binary, g binary"))


def sums(blocks: DataFrame, weights: np.ndarray, left_out: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over ``packed`` rows. ``weights``: (paths, classes, columns + 1); path i trains on the rows
    outside group ``left_out[i]`` (all rows for None). Returns losses (paths, classes),
    gradients (like ``weights``) and, of the rows left out, the counts by (path, true
    class, predicted class)."""
    paths, classes, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, seen = np.zeros((paths, classes)), np.zeros(weights.shape), np.zeros((paths, classes, classes))
        for b in batches:
            for k in range(b.num_rows):
                x, y, g = (np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in enumerate((np.float64, np.int64, np.int64)))
                x = x.reshape(len(y), width)
                sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
                for i, out in enumerate(left_out):
                    m = x @ weights[i].T
                    slack = np.maximum(0, 1 - sign * m)
                    if out is not None:
                        test = g == out
                        slack[test] = 0
                        seen[i] += np.bincount(y[test] * classes + m[test].argmax(1), minlength=classes * classes).reshape(classes, classes)
                    loss[i] += (slack * slack).sum(0)
                    grad[i] -= 2 * (slack * sign).T @ x
        total = np.concatenate((loss.ravel(), grad.ravel(), seen.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    # one row of problems x columns numbers from each of at most MOST_TASKS tasks
    total = np.zeros(paths * classes * (width + 1 + classes))
    for r in blocks.mapInArrow(run, "v binary").collect():
        total += np.frombuffer(r["v"])
    a, b = paths * classes, paths * classes * (width + 1)
    return total[:a].reshape(paths, classes), total[a:b].reshape(weights.shape), total[b:].reshape(paths, classes, classes)


class _Descent:
    """L-BFGS on one problem, fed with the loss and gradient at ``at``."""

    def __init__(self, w: np.ndarray, free: np.ndarray, curvature: np.ndarray, c: float, tol: float, most: int):
        self.free, self.curvature, self.c, self.tol, self.left = free, curvature, c, tol, most
        self.at, self.past, self.value, self.done = w * free, deque(maxlen=PAST), None, False

    def feed(self, loss: float, grad: np.ndarray) -> None:
        if self.done:
            return
        value = 0.5 * self.at @ self.at + self.c * loss
        grad = (self.at + self.c * grad) * self.free
        self.left -= 1
        if self.value is not None:
            if value > self.value + 1e-4 * self.step * (self.grad @ self.way):
                self.step /= 2
                if self.step < 1e-9 or self.left <= 0:
                    self.at, self.done = self.w, True
                else:
                    self.at = self.w + self.step * self.way
                return
            s, y = self.at - self.w, grad - self.grad
            if s @ y > 1e-14 * (y @ y):
                self.past.append((s, y, 1 / (s @ y)))
        self.w, self.value, self.grad = self.at, value, grad
        if np.abs(grad).max() <= self.tol * self.curvature.max() or self.left <= 0:
            self.done = True
            return
        way, back = -grad, []
        for s, y, r in reversed(self.past):
            a = r * (s @ way)
            way, back = way - a * y, [a, *back]
        way = way / self.curvature
        for (s, y, r), a in zip(self.past, back):
            way = way + (a - r * (y @ way)) * s
        self.way, self.step = way, 1.0
        self.at = self.w + way


def _curvature(table: DataFrame, groups: list[int | None], width: int, c: float) -> np.ndarray:
    """1 + 2 C sum(x^2) by path and column: sums by group, without the group left out."""
    cols = [F.sum(F.get("x", F.lit(j)) * F.get("x", F.lit(j))).alias(f"s{j}") for j in range(width - 1)]
    rows = {r["g"]: np.array([r[f"s{j}"] or 0.0 for j in range(width - 1)] + [r["n"]], float)
            for r in table.groupBy("g").agg(*cols, F.count(F.lit(1)).alias("n")).collect()}  # one row per group
    total = sum(rows.values(), np.zeros(width))
    return np.array([1 + 2 * c * (total - (0 if g is None else rows.get(g, 0))) for g in groups])


def fit(table: DataFrame, classes: int, width: int, c: float = 1.0, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """Weights (classes, columns + 1; the last is the intercept) of one-against-rest machines over all rows."""
    curvature = _curvature(table, [None], width, c)
    fits = [_Descent(np.zeros(width), np.ones(width), curvature[0], c, tol, max_iter) for _ in range(classes)]
    blocks = packed(table, width)
    while not all(f.done for f in fits):
        loss, grad, _ = sums(blocks, np.array([[f.at for f in fits]]), [None])
        for k, f in enumerate(fits):
            f.feed(loss[0, k], grad[0, k])
    return np.array([f.w for f in fits])


def f1_weighted(confusion: np.ndarray) -> float:
    """F1 of every true class, weighted by its rows; undefined ratios count as 0."""
    right, true, said = confusion.diagonal(), confusion.sum(1), confusion.sum(0)
    return float((true * 2 * right / np.maximum(true + said, 1)).sum() / max(1, confusion.sum()))


def grid_f1(df: DataFrame, cols: list[str], label: str, fold_col: str, cs: list[float], tol: float = 1e-6, max_iter: int = 100) -> list[float]:
    """Mean weighted F1 over the folds for every ``C``: all folds, classes and values of C share the passes."""
    table, classes = training_table(df, cols, label, fold_col)
    folds = sorted(r[0] for r in table.select("g").distinct().collect() if r[0] is not None)
    width, paths = len(cols) + 1, [(i, g) for i in range(len(cs)) for g in folds]
    curvature = {c: _curvature(table, folds, width, c) for c in set(cs)}
    fits = [[_Descent(np.zeros(width), np.ones(width), curvature[cs[i]][folds.index(g)], cs[i], tol, max_iter) for _ in classes] for i, g in paths]
    scores, live = [[] for _ in cs], list(range(len(paths))) if classes else []
    blocks = packed(table, width)
    while live:
        loss, grad, seen = sums(blocks, np.array([[f.at for f in fits[p]] for p in live]), [paths[p][1] for p in live])
        for j, p in enumerate(list(live)):
            asked = [f.at for f in fits[p]]
            for k, f in enumerate(fits[p]):
                f.feed(loss[j, k], grad[j, k])
            if all(f.done and f.at is w for f, w in zip(fits[p], asked)):
                scores[paths[p][0]].append(f1_weighted(seen[j]))
                live.remove(p)
    return [sum(x) / max(1, len(x)) for x in scores]


class SvmClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """``fit`` as an estimator for pipelines: linear, one against the rest, squared hinge."""

    def __init__(self, C: float = 1.0, maxIter: int = 100, tol: float = 1e-6):
        super().__init__()
        self.c, self.most, self.tol = C, maxIter, tol

    def setLabelCol(self, value: str) -> SvmClassifier:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> SvmClassifier:
        return self._set(predictionCol=value)

    def _fit(self, df: DataFrame) -> SvmModel:
        x = vector_to_array(self.getFeaturesCol())
        x = F.transform(x, lambda v: F.nanvl(v, F.lit(0.0)))
        rows = df.filter(F.col(self.getLabelCol()).isNotNull())
        classes = sorted(r[0] for r in rows.select(self.getLabelCol()).distinct().collect())
        number = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (float(c), i)]), F.col(self.getLabelCol()).cast("double"))
        table = cut_lineage(rows.select(x.alias("x"), number.cast("int").alias("y"), F.lit(0).cast("long").alias("g")))
        width = len(table.first()["x"]) + 1
        weights = fit(table, len(classes), width, self.c, self.tol, self.most)
        return SvmModel(weights, classes)._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class SvmModel(Model, HasFeaturesCol, HasPredictionCol):
    """Class of the greatest decision value, with the decision values as ``rawPrediction``."""

    def __init__(self, weights: np.ndarray, classes: list):
        super().__init__()
        self.weights, self.classes = weights, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.transform(vector_to_array(self.getFeaturesCol()), lambda v: F.nanvl(v, F.lit(0.0)))
        out = df.withColumn("rawPrediction", products(x, self.weights))
        best = F.array_position("rawPrediction", F.array_max("rawPrediction"))
        return out.withColumn(self.getPredictionCol(), F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), best.cast("int")))


def decision(x: list[str], weights: np.ndarray) -> F.Column:
    """Decision values (array<double>, one per class) as an expression over the columns ``x``."""
    def one(w: np.ndarray) -> F.Column:
        out = F.lit(float(w[-1]))
        for c, v in zip(x, w[:-1]):
            out = out + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * float(v)
        return out
    return F.array(*[one(w) for w in weights])


def eliminate(df: DataFrame, cols: list[str], label: str, fold_col: str, min_features: int = 1, c: float = 1.0, tol: float = 1e-6,
              max_iter: int = 100) -> tuple[list[list[str]], dict[int, list[float]]]:
    """Recursive elimination of all rows and of every training part of the folds at once.

    Each path fits its classes, drops the column of smallest weight (sum of squares over the
    classes; the last of equals) and goes on from the weights it has. All paths share
    the passes and none waits for another. Returns the columns kept on all rows, from all down to
    ``min_features``, and for each number of columns the accuracies on the rows left out."""
    table, classes = training_table(df, cols, label, fold_col)
    folds = sorted(r[0] for r in table.select("g").distinct().collect() if r[0] is not None)
    left_out, width, n = [None, *folds], len(cols) + 1, len(classes)
    curvature = _curvature(table, left_out, width, c)
    kept = [list(range(len(cols))) for _ in left_out]

    def start(i: int, w: np.ndarray) -> list[_Descent]:
        free = np.zeros(width)
        free[[*kept[i], width - 1]] = 1
        return [_Descent(x, free, curvature[i], c, tol, max_iter) for x in w]

    fits = [start(i, np.zeros((n, width))) for i in range(len(left_out))]
    path, scores, live = [], {}, list(range(len(left_out))) if n else []
    blocks = packed(table, width)
    while live:
        loss, grad, seen = sums(blocks, np.array([[f.at for f in fits[i]] for i in live]), [left_out[i] for i in live])
        for j, i in enumerate(list(live)):
            asked = [f.at for f in fits[i]]
            for k, f in enumerate(fits[i]):
                f.feed(loss[j, k], grad[j, k])
            if not all(f.done and f.at is w for f, w in zip(fits[i], asked)):  # else this pass has scored the weights they stopped at
                continue
            if i:
                scores.setdefault(len(kept[i]), []).append(float(seen[j].trace() / max(1, seen[j].sum())))
            else:
                path.append([cols[x] for x in kept[i]])
            if len(kept[i]) <= max(1, min_features):
                live.remove(i)
                continue
            weight = sum(f.w[:-1] ** 2 for f in fits[i])
            kept[i].remove(min(kept[i], key=lambda x: (weight[x], -x)))
            fits[i] = start(i, np.array([f.w for f in fits[i]]))
    return path, scores
