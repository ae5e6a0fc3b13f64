"""Exact nearest neighbours over many columns by pivots and the triangle inequality.

A grid over two columns says nothing about distances over twenty. Here a sample of the
points themselves (about the square root of each group's size, ``MAX_PIVOTS`` at most) are
pivots; every point lies in the cell of its nearest pivot and knows its distance to
it. A point's search goes in two steps:

1. Its own cell. The k-th nearest pivot bounds the k-th distance, the k-th neighbour
   inside the cell bounds it better.
2. The other cells that the bound cannot exclude: a cell whose ring of distances to its
   pivot lies farther away than the bound, or that lies behind the plane between the two
   pivots, holds no neighbour. Inside a cell, only points whose distance to the pivot
   differs from the query's by at most the bound are compared over all columns.

Both steps are equi-joins on (group, cell, part); a cell of more than ``hot_rows`` points is
dealt to parts, so no task pairs more than the points of a part with its queries. The
pivots and one row of figures per cell are all that the driver holds. Distances to the
pivots are matrix products in Arrow batches; candidates are compared in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import cut_lineage

MAX_PIVOTS = 16_384  # of all groups together
CHUNK = 1 << 20  # distances of a chunk of points to the pivots
SLACK = 1 + 1e-9  # bounds are widened by rounding errors


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), width)


def _to_pivots(x: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) in chunks of rows."""
    step = max(1, CHUNK // len(p))
    for lo in range(0, len(x), step):
        d = np.zeros((len(x[lo:lo + step]), len(p)))
        for j in range(x.shape[1]):  # exact differences: no cancellation near a pivot
            d += (x[lo:lo + step, j, None] - p[None, :, j]) ** 2
        yield lo, np.sqrt(d)


def sample_pivots(pts: DataFrame, dims: list[str], seed: int = 17) -> dict[int, np.ndarray]:
    """Pivots of every group ``g``: its points whose hash is smallest, about the root of their number."""
    sizes = {r["g"]: r["count"] for r in pts.groupBy("g").count().collect()}  # one row per group
    wanted = {g: math.ceil(math.sqrt(n)) for g, n in sizes.items()}
    shrink = min(1.0, MAX_PIVOTS / max(1, sum(wanted.values())))
    share = {g: max(1.0, wanted[g] * shrink) / n for g, n in sizes.items()}
    rates = pts.sparkSession.createDataFrame(list(share.items()) or [(0, 0.0)], "g long, share double")
    u = F.pmod(F.xxhash64("loc", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = pts.join(rates, "g").filter(u < F.col("share")).select("g", "v").collect()
    out = {g: np.zeros((1, len(dims))) for g in sizes}  # a group without a pivot in the sample is one cell around zero
    for g in {r["g"] for r in rows}:
        out[g] = np.unique(np.array([r["v"] for r in rows if r["g"] == g]), axis=0)
    return out


def _placed(pts: DataFrame, pivots: dict[int, np.ndarray], by: list[str], width: int, k: int) -> DataFrame:
    """pts with cell, r (distance to its pivot) and bound (distance to the k-th nearest other pivot)."""
    kinds = ", ".join(f"`{c}` {pts.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, v = np.asarray(b.column("g")), _vectors(b.column("v"), width)
            cell, r, bound = np.zeros(len(g), np.int32), np.zeros(len(g)), np.full(len(g), np.inf)
            for one in np.unique(g):
                rows, p = np.flatnonzero(g == one), pivots[one]
                for lo, d in _to_pivots(v[rows], p):
                    at = rows[lo:lo + len(d)]
                    cell[at] = d.argmin(1)
                    r[at] = d.min(1)
                    if len(p) > k:  # one of the k + 1 nearest may be the point itself
                        bound[at] = np.partition(d, k, axis=1)[:, k] * SLACK
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r), pa.array(bound)], [*b.schema.names, "cell", "r", "bound"])

    return pts.mapInArrow(run, (kinds + ", " if by else "") + "loc long, v array<double>, g long, cell int, r double, bound double")


def _routes(asked: DataFrame, pivots: dict[int, np.ndarray], rings: dict[int, tuple], by: list[str], width: int) -> DataFrame:
    """For every point of ``asked``: the other cells that may hold a point within its bound, with its distance to their pivots."""
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, v = np.asarray(b.column("g")), _vectors(b.column("v"), width)
            own, bound = np.asarray(b.column("cell")), np.asarray(b.column("bound"))
            for one in np.unique(g):
                rows, p = np.flatnonzero(g == one), pivots[one]
                if len(p) < 2:
                    continue
                near, far = rings[one]
                between = np.maximum(np.concatenate([d for _, d in _to_pivots(p, p)]), 1e-300)
                for lo, d in _to_pivots(v[rows], p):
                    at = rows[lo:lo + len(d)]
                    t, o = bound[at, None], own[at]
                    mine = d[np.arange(len(at)), o][:, None]
                    plane = (d * d - mine * mine) / (2 * between[o])
                    open_ = (d - far <= t) & (near - d <= t) & (plane <= t * SLACK + 1e-9 * d) & np.isfinite(far)
                    open_[np.arange(len(at)), o] = False
                    q, c = np.nonzero(open_)
                    at = pa.array(at[q])
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(x).take(at) for x in by], b.column("loc").take(at), b.column("v").take(at), pa.array(c.astype(np.int32)),
                         pa.array(d[q, c]), b.column("bound").take(at)], [*by, "src", "w", "cell", "dq", "bound"])

    return asked.mapInArrow(run, (kinds + ", " if by else "") + "src long, w array<double>, cell int, dq double, bound double")


def _compared(ask: DataFrame, points: DataFrame, parts: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by..., src, dst, d) of the pairs within the bound: ``ask`` (src, w, cell, dq, bound)
    meets every part of the cell it names."""
    ask = ask.join(parts, [*by, "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    a, p = ask.alias("a"), points.alias("p")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "cell", "part"]]
    d2 = None
    for j in range(width):
        x = F.get(F.col("a.w"), F.lit(j)) - F.get(F.col("p.v"), F.lit(j))
        d2 = x * x if d2 is None else d2 + x * x
    ring = F.abs(F.col("a.dq") - F.col("p.r")) <= F.col("a.bound") * SLACK
    pairs = a.join(p, [*on, ring, F.col("a.src") != F.col("p.loc")]).select(
        *[F.col(f"a.{c}") for c in by], "a.src", F.col("p.loc").alias("dst"), F.sqrt(d2).alias("d"), "a.bound")
    return pairs.filter(F.col("d") <= F.col("bound")).drop("bound")


def pivot_knn(locs: DataFrame, k: int, dims: list[str], by: list[str], hot_rows: int = 4096) -> DataFrame:
    """(by..., src, dst, d) for every two locations of a group whose distance is at most the
    k-th smallest one of ``src`` (ties included). ``locs``: by..., loc, dims..., distinct
    coordinates; locations with a null coordinate take no part."""
    width = len(dims)
    whole = F.lit(True)
    for c in dims:
        whole = whole & F.col(c).isNotNull()
    names, by = by, [f"__by{i}" for i in range(len(by))]
    pts = cut_lineage(locs.filter(whole).select(*[F.col(c).alias(b) for c, b in zip(names, by)], F.col("loc").cast("long").alias("loc"), F.array(*[F.col(c).cast("double") for c in dims]).alias("v"),
                                                (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("g")))
    pivots = sample_pivots(pts, dims)
    placed = cut_lineage(_placed(pts, pivots, by, width, k))
    rings = {}
    for r in placed.groupBy("g", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect():  # one row per pivot
        near, far = rings.setdefault(r["g"], (np.full(len(pivots[r["g"]]), np.inf), np.full(len(pivots[r["g"]]), -np.inf)))
        near[r["cell"]], far[r["cell"]] = r["lo"] / SLACK, r["hi"] * SLACK
    sizes = placed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(sizes.select(*by, "cell", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    same = [placed[c].eqNullSafe(parts[c]) for c in [*by, "cell"]]
    points = placed.join(parts, same).select(*[placed[c] for c in by], "loc", "v", placed["cell"], "r",
                                             F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int").alias("part"))
    points = cut_lineage(points)
    w = Window.partitionBy(*by, "src").orderBy("d")

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= k).drop("__r")

    own = placed.select(*by, F.col("loc").alias("src"), F.col("v").alias("w"), "cell", F.col("r").alias("dq"), "bound")
    first = cut_lineage(nearest(_compared(own, points, parts, by, width)))
    kth = first.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("m"), F.max("d").alias("dk")).filter(F.col("m") >= k).select(
        *by, F.col("src").alias("loc"), "dk")
    better = placed.join(kth.hint("merge"), [placed[c].eqNullSafe(kth[c]) for c in [*by, "loc"]], "left").select(
        *[placed[c] for c in by], placed["loc"], "v", "g", "cell", F.least("bound", F.col("dk") * SLACK).alias("bound"))
    routed = _routes(cut_lineage(better), pivots, rings, by, width)
    out = nearest(first.unionByName(_compared(routed, points, parts, by, width)))
    return out.select(*[F.col(b).alias(c) for c, b in zip(names, by)], "src", "dst", "d")
