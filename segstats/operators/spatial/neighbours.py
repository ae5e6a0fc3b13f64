"""Sums over the neighbours within distance bands, without a table of edges.

The number of edges of a band grows with the square of the number of points; what is
summed over them does not. Points are packed into parts that lie close together (along a
space-filling curve, at most ``PART`` points), and a part meets the parts that its widest
band can reach, ``REACH`` of them in one task. Inside a task, small runs of points (``RUN``) carry
their bounding boxes: two runs that lie within a band altogether count as sums, runs
beyond it are skipped, and only the others are compared point by point. A task holds
``REACH`` + 1 parts whatever the data look like, also if all points share one spot.

Two points are neighbours when their squared distance is at most band * band and their
ids differ; rows with a null id or without finite coordinates have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import cut_lineage

PART, RUN, REACH = 4096, 128, 16
BITS = 15  # of a coordinate on the curve
SLACK = 1e-9  # boxes decide only where rounding cannot matter


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """(part, x0, x1, y0, y1, ids, xy, values): points close together; ``rows``: id, x, y, v (array)."""
    box = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    curve = F.lit(0).cast("long")
    for axis, shift in (("x", 0), ("y", 1)):
        lo, hi = box[f"{axis}0"], box[f"{axis}1"]
        span = (hi - lo) if lo is not None and 0 < hi - lo < float("inf") else 1.0
        at = F.least(F.floor((F.col(axis) - F.lit(lo or 0.0)) / F.lit(span) * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))
        for b in range(BITS):  # bits of x and y in turn
            curve = curve.bitwiseOR(F.shiftleft(F.shiftright(at, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + shift))
    placed = rows.withColumn("curve", curve).repartitionByRange("curve", "x", "y", "id").sortWithinPartitions("curve", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                s = pa.Table.from_batches([b.slice(lo, PART)]).combine_chunks()
                x, y = (np.asarray(s[c]).astype(np.float64) for c in "xy")
                v = np.asarray(s["v"].chunk(0).flatten()).astype(np.float64).reshape(len(x), width)
                yield pa.RecordBatch.from_pydict({
                    "part": [part], "x0": [x.min()], "x1": [x.max()], "y0": [y.min()], "y1": [y.max()], "ids": [s["id"].to_pylist()],
                    "xy": [np.stack((x, y), 1).tobytes()], "values": [v.tobytes()]}, schema=schema)
                part += 1

    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("part", pa.int64()), *((c, pa.float64()) for c in ("x0", "x1", "y0", "y1")),
                        ("ids", pa.list_(pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32())),
                        ("xy", pa.binary()), ("values", pa.binary())])
    return cut_lineage(placed.select("id", "x", "y", "v").mapInArrow(
        run, f"part long, x0 double, x1 double, y0 double, y1 double, ids array<{kind}>, xy binary, values binary"))


def _boxes(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(xy), RUN)
    return np.minimum.reduceat(xy, at), np.maximum.reduceat(xy, at)


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with equal ids."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    i = np.repeat(np.arange(len(a)), hi - lo)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]


def band_sums(a: tuple, b: tuple, bands: np.ndarray, values: list[np.ndarray], powers: np.ndarray, inverse: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of a run of ``a``, band, [number of neighbours, weighted sums of the columns of ``values[band]``])
    over the points of ``b``. A weight is 1, or 1 / distance to the power of its column (none at distance 0)."""
    (ids, xy), (other, to) = a, b
    alo, ahi = _boxes(xy)
    blo, bhi = _boxes(to)
    start = np.arange(0, len(to), RUN)
    whole = [np.add.reduceat(v, start, axis=0) for v in values] if not inverse else None
    size = np.diff(np.append(start, len(to)))
    i, j = _same(ids, other)
    shared = np.zeros((len(alo), len(blo)), bool)
    shared[i // RUN, j // RUN] = True
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for r in range(len(alo)):
        lo, hi = r * RUN, min(len(xy), (r + 1) * RUN)
        gap = np.maximum(0, np.maximum(blo - ahi[r], alo[r] - bhi))
        far = np.maximum(bhi - alo[r], ahi[r] - blo)
        least, most = (gap * gap).sum(1), (far * far).sum(1)
        some = least[:, None] <= bands * bands * (1 + SLACK)
        all_ = (most[:, None] < bands * bands * (1 - SLACK)) & ~shared[r][:, None] & (not inverse)
        mixed = some & ~all_
        near = np.flatnonzero(mixed.any(1))
        at = (near[:, None] * RUN + np.arange(RUN)).ravel()
        run_of = np.repeat(near, RUN)[at < len(to)]
        at = at[at < len(to)]
        d2 = (xy[lo:hi, None, 0] - to[None, at, 0]) ** 2 + (xy[lo:hi, None, 1] - to[None, at, 1]) ** 2
        f, t = np.searchsorted(i, lo), np.searchsorted(i, hi)
        place = np.full(len(to), -1)
        place[at] = np.arange(len(at))
        ii, jj = i[f:t] - lo, place[j[f:t]]
        d2[ii[jj >= 0], jj[jj >= 0]] = np.inf  # shared ids are always compared
        for k, band in enumerate(bands):
            use = mixed[run_of, k]
            if not use.any() and not all_[:, k].any():
                continue
            every = use.all()
            v = values[k][at if every else at[use]]
            inside = (d2 if every else d2[:, use]) <= band * band
            out = np.zeros((hi - lo, 1 + v.shape[1]))
            out[:, 0] = inside.sum(1)
            if not inverse:
                out[:, 1:] = inside.astype(np.float64) @ v
                out[:, 0] += size[all_[:, k]].sum()
                out[:, 1:] += whole[k][all_[:, k]].sum(0)
            else:
                d = np.sqrt(d2 if every else d2[:, use])
                with np.errstate(divide="ignore"):
                    w = np.where(inside & (d > 0), 1.0 / d, 0.0)
                out[:, 0] = (w > 0).sum(1)
                for p in np.unique(powers):
                    out[:, 1 + np.flatnonzero(powers == p)] = w ** p @ v[:, powers == p]
            yield lo, k, out


def _meetings(parts: DataFrame, widest: float) -> tuple[DataFrame, DataFrame]:
    """(part, group, data) of both sides: a part, and ``REACH`` of those within reach of it."""
    one = parts.select("part", "x0", "x1", "y0", "y1")
    to = one.select(*[F.col(c).alias(f"t_{c}") for c in one.columns])
    gx = F.greatest(F.lit(0.0), F.col("t_x0") - F.col("x1"), F.col("x0") - F.col("t_x1"))
    gy = F.greatest(F.lit(0.0), F.col("t_y0") - F.col("y1"), F.col("y0") - F.col("t_y1"))
    pairs = one.join(to, gx * gx + gy * gy <= F.lit(widest * widest * (1 + SLACK))).select("part", F.col("t_part").alias("to"))
    w = Window.partitionBy("part").orderBy("to")
    pairs = cut_lineage(pairs.withColumn("group", F.floor((F.row_number().over(w) - 1) / REACH).cast("long")))
    data = ["ids", "xy", "values"]
    left = parts.select("part", *data).join(pairs.select("part", "group").distinct(), "part").select("part", "group", *data)
    right = pairs.join(parts.select(F.col("part").alias("to"), *data), "to").select("part", "group", *data).toDF("part", "group", *data)
    return left, right


def _finite(x: str, y: str) -> F.Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))


def neighbour_sums(pts: DataFrame, bands: list[float], values: dict[str, tuple[int, F.Column]], id_col: str = "id", x: str = "x", y: str = "y",
                   inverse: bool = False, param: str = "param") -> DataFrame:
    """(id, param, neighbours, one column of each of ``values``): for every row and band with a neighbour, their number
    and the sums of the values over them. ``values``: name -> (power of the weight 1 / distance if ``inverse``,
    column: a number, or an array with one number for each band); nulls add nothing. Several rows
    of one id are separate points."""
    n, arrays = len(bands), [c for c, (_, v) in values.items() if pts.select(v.alias(c)).schema[c].dataType.typeName() == "array"]
    flat = []
    for c, (_, v) in values.items():
        flat += [F.coalesce((F.get(v, F.lit(k)) if c in arrays else v).cast("double"), F.lit(0.0)) for k in range(n if c in arrays else 1)]
    columns, at = [], 0  # per band: places of the values in the packed row
    for c in values:
        columns.append([at + (k if c in arrays else 0) for k in range(n)])
        at += n if c in arrays else 1
    place, powers, width = np.array(columns, int).reshape(len(values), n).T, np.array([p for p, _ in values.values()], int), max(at, 1)
    rows = pts.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                      F.array(*(flat or [F.lit(0.0)])).alias("v")).filter(F.col("id").isNotNull() & _finite("x", "y"))
    left, right = _meetings(_parts(rows, width), max(bands))
    names, limits, kind = [*values], np.array(bands, float), rows.schema["id"].dataType.simpleString()

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, xy = np.asarray(a["ids"].iloc[0]), np.frombuffer(a["xy"].iloc[0]).reshape(-1, 2)
        total = np.zeros((n, len(ids), 1 + len(names)))
        for other, to, v in zip(b["ids"], b["xy"], b["values"]):
            v = np.frombuffer(v).reshape(-1, width)
            for lo, k, out in band_sums((ids, xy), (np.asarray(other), np.frombuffer(to).reshape(-1, 2)), limits,
                                        [v[:, place[k]] for k in range(n)], powers, inverse):
                total[k, lo:lo + len(out)] += out
        k, i = np.nonzero(total[:, :, 0])
        return pd.DataFrame({"id": ids[i], param: limits[k], "neighbours": total[k, i, 0].astype(np.int64),
                             **{c: total[k, i, 1 + z] for z, c in enumerate(names)}})

    return left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInPandas(
        meet, f"id {kind}, `{param}` double, neighbours long" + "".join(f", `{c}` double" for c in names))


def per_id(sums: DataFrame, *names: str, param: str = "param") -> DataFrame:
    """``neighbour_sums`` with the rows of one id added up."""
    return sums.groupBy(param, "id").agg(F.sum("neighbours").alias("neighbours"), *[F.sum(c).alias(c) for c in names])


def neighbour_products(pts: DataFrame, band: float, weight: str, vector: str, width: int, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(place, total): for every place of the array ``vector`` (nulls count 0) the sum of weight_p * vector_p * vector_q over the
    neighbours p, q within the band."""
    numbers = F.transform(F.concat(F.array(F.col(weight)), F.col(vector)), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    rows = pts.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), numbers.alias("v"))
    left, right = _meetings(_parts(rows.filter(F.col("id").isNotNull() & _finite("x", "y")), 1 + width), band)
    limits = np.array([band], float)

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, xy, own = np.asarray(a["ids"].iloc[0]), np.frombuffer(a["xy"].iloc[0]).reshape(-1, 2), np.frombuffer(a["values"].iloc[0]).reshape(-1, 1 + width)
        total = np.zeros(width)
        for other, to, v in zip(b["ids"], b["xy"], b["values"]):
            v = np.frombuffer(v).reshape(-1, 1 + width)[:, 1:]
            for lo, _, out in band_sums((ids, xy), (np.asarray(other), np.frombuffer(to).reshape(-1, 2)), limits, [v], np.ones(width, int), False):
                mine = own[lo:lo + len(out)]
                total += (mine[:, :1] * mine[:, 1:] * out[:, 1:]).sum(0)
        return pd.DataFrame({"place": np.arange(width), "total": total})

    got = left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInPandas(meet, "place int, total double")
    return got.groupBy("place").agg(F.sum("total").alias("total"))
