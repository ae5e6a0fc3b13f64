"""Exact nearest locations in the plane, compared inside tasks.

Distinct locations are packed into parts that lie close together (along a space-filling
curve, ``PART`` at most, one group to a part). The k-th nearest one inside its own part bounds what a
location can still gain elsewhere; a part meets the parts that its largest bound reaches, ``REACH`` of
them in one task. There, runs of ``RUN`` locations carry bounding boxes, and only runs within the
bound are compared. Pairs never become rows: a task gives back the k nearest (and those as
near as the k-th) of each location, and holds ``REACH`` + 1 parts whatever the data look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.operators.spatial.neighbours import _finite
from segstats.session import cut_lineage

PART, RUN, REACH = 2048, 64, 32
BITS = 24  # of a coordinate on the curve
SLACK = 1 + 1e-9  # boxes decide only where rounding cannot matter


def _curve(rows: DataFrame) -> F.Column:
    """Place on the curve: the bits of x and y in turn."""
    box = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    out = F.lit(0).cast("long")
    for axis, shift in (("x", 0), ("y", 1)):
        lo, hi = box[f"{axis}0"], box[f"{axis}1"]
        span = (hi - lo) if lo is not None and 0 < hi - lo < float("inf") else 1.0
        at = F.least(F.floor((F.col(axis) - F.lit(lo or 0.0)) / F.lit(span) * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))
        for b in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(at, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + shift))
    return out


def _boxes(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(xy), RUN)
    return np.minimum.reduceat(xy, at), np.maximum.reduceat(xy, at)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dx, dy = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
    return np.sqrt(dx * dx + dy * dy)


def _own_bounds(ids: np.ndarray, xy: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest other location of the same part (infinite where there are fewer)."""
    if len(xy) <= k:
        return np.full(len(xy), np.inf)
    out = []
    for lo in range(0, len(xy), RUN):
        d = _distances(xy[lo:lo + RUN], xy)
        d[ids[lo:lo + RUN, None] == ids[None, :]] = np.inf
        out.append(np.partition(d, k - 1, axis=1)[:, k - 1])
    return np.concatenate(out)


def _parts(rows: DataFrame, by: list[str], k: int, size: int) -> DataFrame:
    """(by..., part, x0, x1, y0, y1, reach, ids, xy, bounds); ``rows``: by..., id, x, y."""
    types = {c: rows.schema[c].dataType.simpleString() for c in [*by, "id"]}
    g = F.xxhash64(*by) if by else F.lit(0).cast("long")
    rows = rows.withColumn("g", g).withColumn("curve", _curve(rows))
    placed = rows.repartitionByRange("g", "curve", "x", "y").sortWithinPartitions("g", "curve", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, None

        def packed(t: pa.Table, pieces: int) -> Iterator[pa.RecordBatch]:
            nonlocal part
            group = np.asarray(t["g"])
            cuts = {0, len(group), *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(),
                    *(len(group) * i // pieces for i in range(1, pieces))}
            cuts = sorted(cuts)
            for lo, hi in zip(cuts, cuts[1:]):
                s = t.slice(lo, hi - lo)
                xy = np.stack([np.asarray(s[c]).astype(np.float64) for c in "xy"], 1)
                ids = s["id"].to_pylist()
                bounds = _own_bounds(np.asarray(ids), xy, k)
                (x0, y0), (x1, y1) = xy.min(0), xy.max(0)
                row = [*(s[c].slice(0, 1).to_pylist() for c in by), *([v] for v in (part, x0, x1, y0, y1, bounds.max())), [ids],
                       [xy.tobytes()], [bounds.tobytes()]]
                kinds = [*(s.schema.field(c).type for c in by), pa.int64(), *[pa.float64()] * 5, pa.list_(s.schema.field("id").type), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row, kinds)], names)
                part += 1

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            while held.num_rows > 3 * size:
                yield from packed(held.slice(0, size), 1)
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield from packed(held, -(-held.num_rows // size))  # evenly: a part of few locations would have loose bounds

    names = [*by, "part", "x0", "x1", "y0", "y1", "reach", "ids", "xy", "bounds"]
    schema = "".join(f"`{c}` {types[c]}, " for c in by) + (
        f"part long, x0 double, x1 double, y0 double, y1 double, reach double, ids array<{types['id']}>, xy binary, bounds binary")
    return cut_lineage(placed.select(*by, "id", "x", "y", "g").mapInArrow(run, schema))


def nearer(ids: np.ndarray, xy: np.ndarray, bounds: np.ndarray, other: np.ndarray, to: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``xy``, places in ``to``, distances) of the pairs within the bounds, which shrink (in place) to the
    k-th distance seen; a location is not its own neighbour."""
    (alo, ahi), (blo, bhi) = _boxes(xy), _boxes(to)
    for r in range(len(alo)):
        lo, hi = r * RUN, min(len(xy), (r + 1) * RUN)
        gap = np.maximum(0, np.maximum(blo - ahi[r], alo[r] - bhi))
        near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= bounds[lo:hi].max() * SLACK)
        if not len(near):
            continue
        at = (near[:, None] * RUN + np.arange(RUN)).ravel()
        at = at[at < len(to)]
        d = _distances(xy[lo:hi], to[at])
        d[ids[lo:hi, None] == other[None, at]] = np.inf
        if len(at) >= k:
            bounds[lo:hi] = np.minimum(bounds[lo:hi], np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((d <= bounds[lo:hi, None]) & np.isfinite(d))
        yield lo + i, at[j], d[i, j]


def nearest_locations(locs: DataFrame, k: int, x: str, y: str, by: list[str], size: int = PART) -> DataFrame:
    """(by..., src, dst, d) for every two locations of a group whose distance is at most the k-th smallest one of
    ``src`` (ties included). ``locs``: by..., loc, x, y, distinct coordinates; locations without finite
    coordinates or with a null group take no part."""
    names, by = by, [f"__by{i}" for i in range(len(by))]
    rows = locs.select(*[F.col(c).alias(b) for c, b in zip(names, by)], F.col("loc").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & _finite("x", "y")).dropna(subset=by or None) if by else rows.filter(F.col("id").isNotNull() & _finite("x", "y"))
    parts = _parts(rows, by, k, size)
    one = parts.select(*by, "part", "x0", "x1", "y0", "y1", "reach")
    to = one.drop("reach").select(*by, *[F.col(c).alias(f"t_{c}") for c in ("part", "x0", "x1", "y0", "y1")])
    gx = F.greatest(F.lit(0.0), F.col("t_x0") - F.col("x1"), F.col("x0") - F.col("t_x1"))
    gy = F.greatest(F.lit(0.0), F.col("t_y0") - F.col("y1"), F.col("y0") - F.col("t_y1"))
    met = (one.join(to, by) if by else one.crossJoin(to)).filter(F.sqrt(gx * gx + gy * gy) <= F.col("reach") * SLACK)
    # the nearest parts first: they shrink the bounds
    w = Window.partitionBy("part").orderBy(gx * gx + gy * gy, "to")
    pairs = met.withColumn("to", F.col("t_part")).withColumn("group", F.floor((F.row_number().over(w) - 1) / REACH).cast("long"))
    pairs = cut_lineage(pairs.select("part", "to", "group", (gx * gx + gy * gy).alias("gap")))
    left = parts.join(pairs.select("part", "group").distinct(), "part").select(*by, "part", "group", "ids", "xy", "bounds").toDF(*by, "part", "group", "ids", "xy", "bounds")
    right = pairs.join(parts.select(F.col("part").alias("to"), "ids", "xy"), "to").select("part", "group", "to", "gap", "ids", "xy").toDF("part", "group", "to", "gap", "ids", "xy")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, xy = np.asarray(a["ids"].iloc[0]), np.frombuffer(a["xy"].iloc[0]).reshape(-1, 2)
        bounds, found = np.frombuffer(a["bounds"].iloc[0]).copy(), []
        b = b.sort_values(["gap", "to"])
        for other, there in zip(b["ids"], b["xy"]):
            other = np.asarray(other)
            found += [(i, other[j], d) for i, j, d in nearer(ids, xy, bounds, other, np.frombuffer(there).reshape(-1, 2), k)]
        i, dst, d = (np.concatenate(c) if c else np.zeros(0, int) for c in (zip(*found) if found else ((), (), ())))
        keep = d <= bounds[i] if len(i) else np.zeros(0, bool)
        i, dst, d = i[keep].astype(int), dst[keep], d[keep]
        order = np.lexsort((d, i))
        i, dst, d = i[order], dst[order], d[order]
        # ranks with ties: up to the k-th smallest distance of each location
        first = np.searchsorted(i, i)
        last = np.minimum(first + k - 1, np.searchsorted(i, i, "right") - 1)
        keep = d <= d[last] if len(i) else keep[:0]
        n, plain = int(keep.sum()), (lambda v: pd.Series(list(v), dtype=object) if v.dtype.kind in "OUS" else v)
        out = {c: pd.Series([a[c].iloc[0]] * n, dtype=object) for c in by}
        return pd.DataFrame({**out, "src": plain(ids[i[keep]]), "dst": plain(np.asarray(dst)[keep]), "d": d[keep]})

    kind = rows.schema["id"].dataType.simpleString()
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by) + f"src {kind}, dst {kind}, d double"
    got = left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInPandas(meet, schema)
    ranked = got.withColumn("__r", F.rank().over(Window.partitionBy(*by, "src").orderBy("d"))).filter(F.col("__r") <= k)
    return ranked.select(*[F.col(b).alias(c) for c, b in zip(names, by)], "src", "dst", "d")
