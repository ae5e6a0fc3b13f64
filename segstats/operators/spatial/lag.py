"""Neighbour-average features and the self + neighbour matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators.spatial.neighbours import neighbour_sums, per_id

SUFFIX = "_neighbor"


def neighbour_mean(x: DataFrame, edges: DataFrame, cols: list[str], id_col: str = "id",
                   fill: float | None = 0.0) -> DataFrame:
    """``<c>_neighbor`` = plain mean of c over the neighbours (self excluded)
    for every column in one grouped aggregate; islands get null, then ``fill``."""
    xd = x.select(F.col(id_col).alias("dst"), *cols)
    agg = (edges.select("src", "dst").join(xd, "dst")
           .groupBy("src").agg(*[F.avg(c).alias(c + SUFFIX) for c in cols]))
    out = x.select(id_col).join(agg.withColumnRenamed("src", id_col), id_col, "left")
    return out.na.fill(fill, subset=[c + SUFFIX for c in cols]) if fill is not None else out


def band_neighbour_mean(x: DataFrame, band: float, cols: list[str], id_col: str = "id", fill: float | None = 0.0) -> DataFrame:
    """``neighbour_mean`` of the edges within ``band`` without a table of edges: sums and counts of the
    values that are not null; values that are not finite are counted apart, as a sum of zeros and
    infinities would hide them."""
    inf = float("inf")
    kinds = {"n": lambda v: v.isNotNull(), "nan": lambda v: F.isnan(v), "up": lambda v: v == inf, "down": lambda v: v == -inf}
    own = x.groupBy(F.col(id_col).alias("__id")).agg(
        *[F.sum(F.when(~F.isnan(c) & (F.abs(c) < inf), F.col(c).cast("double"))).alias(f"__sum{i}") for i, c in enumerate(cols)],
        *[F.count_if(is_(F.col(c))).alias(f"__{k}{i}") for i, c in enumerate(cols) for k, is_ in kinds.items()])
    names = [f"__{k}{i}" for i in range(len(cols)) for k in ("sum", *kinds)]
    pts = x.select(F.col(id_col).alias("__id"), "x", "y").join(own, "__id")
    sums = per_id(neighbour_sums(pts, [band], {c: (0, F.col(c)) for c in names}, "__id"), *names)

    def mean(i: int) -> F.Column:
        nan, up, down = (F.col(f"__{k}{i}") > 0 for k in ("nan", "up", "down"))
        return F.when(nan | (up & down), F.lit(float("nan"))).when(up, inf).when(down, -inf).when(
            F.col(f"__n{i}") > 0, F.col(f"__sum{i}") / F.col(f"__n{i}"))

    agg = sums.select(F.col("id").alias(id_col), *[mean(i).alias(c + SUFFIX) for i, c in enumerate(cols)])
    out = x.select(id_col).join(agg, id_col, "left")
    return out.na.fill(fill, subset=[c + SUFFIX for c in cols]) if fill is not None else out


def spatial_matrix(x: DataFrame, nb: DataFrame, id_col: str = "id", neighbour_only: bool = False) -> DataFrame:
    """Self + neighbour matrix (left join on id) or the neighbour-only one."""
    if neighbour_only:
        return nb
    return x.join(nb, id_col, "left")
