"""Scaling and feature selection fitted on train, applied to train and test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.session import cut_lineage


def max_cutoff(c: str, max_: float = 1000.0, alpha: float = 0.75) -> F.Column:
    """least((x / max) ** alpha, 1): compresses heavy tails and caps at 1.
    (The reference's helper is not published; this follows its printed
    parameters max=1000, alpha=0.75.)"""
    return F.least(F.pow(F.col(c) / F.lit(float(max_)), F.lit(float(alpha))), F.lit(1.0))


def fit_minmax(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Column min / max on train: one aggregate row to the driver."""
    row = train.agg(*[x for i, c in enumerate(cols) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def apply_minmax(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - min) / (max - min) with train statistics; test rows may leave
    [0, 1]. A zero train range divides by 1 (sklearn), so a constant train
    column maps to 0 on train."""
    out = []
    for c in df.columns:
        if c in fitted and fitted[c][0] is not None:
            lo, hi = fitted[c]
            rng = float(hi - lo) if hi != lo else 1.0
            out.append(((F.col(c) - F.lit(float(lo))) / F.lit(rng)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def variances(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population variance per column, long form (column, var), one pass."""
    wide = df.agg(*[F.var_pop(c).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("var")) for c in cols])).alias("s")).select("s.*")


def variance_select(df: DataFrame, cols: list[str], thres: float = 0.0) -> list[str]:
    """Columns whose population variance exceeds ``thres`` (VarianceThreshold)."""
    row = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"v{i}"] is not None and row[f"v{i}"] > thres]


def equal_width_bins(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Each column replaced by its equal-width bin 1..bins over [min, max]
    (max folded into the last bin; a constant column is bin 1). One aggregate
    row of min / max reaches the driver."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None or hi is None or hi == lo:
                out.append(F.when(F.col(c).isNotNull(), F.lit(1).cast("long")).alias(c))
            else:
                b = F.width_bucket(F.col(c).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
                out.append(F.least(b, F.lit(bins).cast("long")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def mutual_information(binned: DataFrame, cols: list[str], target: str, feature: str = "feature") -> DataFrame:
    """MI (nats) of every binned column with ``target`` from one grouped count
    of (feature, bin, target) over the unpivoted columns."""
    long = binned.select(F.col(target).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias(feature), F.col(c).alias("__x")) for c in cols])).alias("__kv")
    ).select(f"__kv.{feature}", "__kv.__x", "__y").filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    nxy = long.groupBy(feature, "__x", "__y").agg(F.count(F.lit(1)).alias("nxy"))
    nx = nxy.groupBy(feature, "__x").agg(F.sum("nxy").alias("nx"))
    ny = nxy.groupBy(feature, "__y").agg(F.sum("nxy").alias("ny"))
    n = nxy.groupBy(feature).agg(F.sum("nxy").alias("n"))
    j = nxy.join(nx, [feature, "__x"]).join(ny, [feature, "__y"]).join(n, feature)
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy(feature).agg(F.sum(term).alias("mi"))


def pair_counts(binned: DataFrame, cols: list[str], bins: int, target: str) -> DataFrame:
    """(a, b, x, y, nxy): joint counts of the bins of every two columns and of every column with the
    target (number ``len(cols)``), from one pass. A batch's rows become indicator columns, one
    per (column, bin); the product of that matrix with itself holds the counts of all pairs.
    Tasks add up their batches and send the counts that are not 0, which one grouped sum brings together."""
    classes = sorted(r[0] for r in binned.select(target).distinct().collect() if r[0] is not None)  # one row per class
    p, wide = len(cols), max(bins, len(classes))
    y = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i + 1)]), F.col(target)) if classes else F.lit(0)
    codes = F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in [*[F.col(c) for c in cols], y]])
    width = (p + 1) * wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            code = np.asarray(b.column(0).flatten()).reshape(b.num_rows, p + 1)
            for lo in range(0, len(code), 4096):  # counts of a slice are exact in single precision
                part = code[lo:lo + 4096]
                row, col = np.nonzero(part)
                ones = np.zeros((len(part), width), np.float32)
                ones[row, col * wide + part[row, col] - 1] = 1
                total += ones.T @ ones
        i, j = np.nonzero(np.triu(total))
        keep = i // wide < j // wide
        i, j = i[keep], j[keep]
        yield pa.RecordBatch.from_arrays([pa.array((i * width + j).astype(np.int64)), pa.array(total[i, j].astype(np.int64))], ["code", "n"])

    n = binned.select(codes.alias("c")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("nxy"))
    i, j = F.floor(F.col("code") / width), F.col("code") % width
    return n.select(F.floor(i / wide).alias("a"), F.floor(j / wide).alias("b"), (i % wide).alias("x"), (j % wide).alias("y"), "nxy")


def pairwise_information(binned: DataFrame, cols: list[str], bins: int, target: str) -> np.ndarray:
    """Mutual information (nats) of every two columns and, in the last row and column, with the target (NaN
    where no row has both values)."""
    n = pair_counts(binned, cols, bins, target)
    nx = n.groupBy("a", "b", "x").agg(F.sum("nxy").alias("nx"))
    ny = n.groupBy("a", "b", "y").agg(F.sum("nxy").alias("ny"))
    all_ = n.groupBy("a", "b").agg(F.sum("nxy").alias("n"))
    j = n.join(nx, ["a", "b", "x"]).join(ny, ["a", "b", "y"]).join(all_, ["a", "b"])
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    out = np.full((len(cols) + 1, len(cols) + 1), np.nan)
    for r in j.groupBy("a", "b").agg(F.sum(term).alias("mi")).collect():  # one row per pair of columns
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["mi"]
    return out


def mrmr(df: DataFrame, cols: list[str], target: str, k: int, bins: int = 10) -> DataFrame:
    """Greedy minimum-redundancy maximum-relevance ranking (MID criterion:
    relevance minus mean MI with the features already chosen). The information of all
    pairs comes from one pass, whatever ``k``; the greedy steps run on that table."""
    spark = df.sparkSession
    b = cut_lineage(equal_width_bins(df.select(*cols, target), cols, bins))
    mi = pairwise_information(b, cols, bins, target)
    rel = {c: mi[i, -1] for i, c in enumerate(cols) if not np.isnan(mi[i, -1])}
    chosen: list[tuple[str, float, float]] = []
    red = {c: 0.0 for c in cols}
    remaining = [c for c in cols if c in rel]
    while remaining and len(chosen) < k:
        score = {c: rel[c] - (red[c] / len(chosen) if chosen else 0.0) for c in remaining}
        best = max(remaining, key=lambda c: (score[c], -cols.index(c)))
        chosen.append((best, float(rel[best]), float(score[best])))
        remaining.remove(best)
        for c in remaining:
            red[c] += np.nan_to_num(mi[cols.index(c), cols.index(best)])
    rows = [(i + 1, f, r, s) for i, (f, r, s) in enumerate(chosen)]
    return spark.createDataFrame(rows, "rank int, feature string, relevance double, score double")
