"""Least-squares models of all folds and penalties from one pass.

One pass sums the products of (x, y, 1) by fold (``grams``). A fold's training sums are the
total without the fold, so every penalty's coefficients and its error on the rows left
out follow from the same small matrices on the driver: ordinary and ridge regression in
closed form, lasso by coordinate descent. Penalties are those of Spark ML's linear
regression: mean squared error / 2 plus ``regParam`` on standardised columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(df: DataFrame, cols: list[str], label: str, group: str) -> dict:
    """Sums of products of (cols..., label, 1), a square matrix for each ``group``."""
    width = len(cols) + 2
    up = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            x = np.column_stack((np.asarray(b.column(0).flatten()).reshape(b.num_rows, width - 1), np.ones(b.num_rows)))
            g = np.asarray(b.column(1))
            for k in np.unique(g):
                z = x[g == k]
                total[k] = total.get(k, 0) + z.T @ z
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up[0]), k)), pa.array(np.arange(len(up[0]))), pa.array(m[up])], ["g", "i", "v"])

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in [*cols, label]])
    rows = df.filter(F.col(group).isNotNull()).select(x.alias("x"), F.col(group).cast("long").alias("g"))
    out: dict = {}
    for r in rows.mapInArrow(run, "g long, i long, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r["g"], np.zeros((width, width)))
        i, j = up[0][r["i"]], up[1][r["i"]]
        m[i, j] = m[j, i] = r["v"]
    return out


def coefficients(gram: np.ndarray, reg: float, mix: float, sweeps: int = 10_000) -> np.ndarray:
    """Weights and intercept of the penalised fit; ``mix`` is the share of the absolute penalty."""
    n = gram[-1, -1]
    mean = gram[-1, :-1] / n
    cov = gram[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(cov.diagonal(), 0))
    sd[sd < 1e-9 * np.abs(mean)] = 0  # constant up to rounding
    p, sy = len(mean) - 1, sd[-1]
    w, live = np.zeros(p), np.flatnonzero(sd[:-1])
    if sy and len(live):
        r = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        t = cov[live, -1] / (sd[live] * sy)
        flat, ridge = reg / sy * mix, reg / sy * (1 - mix)
        if flat:
            beta = np.zeros(len(live))
            for _ in range(sweeps):
                before = beta.copy()
                for j in range(len(live)):
                    rest = t[j] - r[j] @ beta + r[j, j] * beta[j]
                    beta[j] = np.sign(rest) * max(abs(rest) - flat, 0) / (r[j, j] + ridge)
                if np.abs(beta - before).max() < 1e-12:
                    break
        else:
            beta = np.linalg.lstsq(r + ridge * np.eye(len(live)), t, rcond=1e-12)[0]
        w[live] = beta * sy / sd[live]
    return np.append(w, mean[-1] - w @ mean[:-1])


def mse(gram: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error on the rows of ``gram``."""
    residual = np.concatenate((w[:-1], [-1.0], w[-1:]))
    return float(max(residual @ gram @ residual, 0) / gram[-1, -1])


def grid_mse(df: DataFrame, cols: list[str], label: str, fold_col: str, penalties: list[tuple[float, float]]) -> list[float]:
    """Mean over the folds of the error on the rows left out, for every (regParam, share of the absolute penalty)."""
    by = grams(df, cols, label, fold_col)
    total = sum(by.values())
    return [sum(mse(m, coefficients(total - m, reg, mix)) for m in by.values()) / max(1, len(by)) for reg, mix in penalties]
