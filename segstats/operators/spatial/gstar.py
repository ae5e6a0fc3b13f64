"""Local G* hot / cold spots (binary weights, self included)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.expressions import normal_sf, sig_level
from segstats.operators.spatial.neighbours import neighbour_sums, per_id

# Map colours per spot and significance level (0, 1, 2), and the
# neutral colour, as used by the reference's hot-spot map.
SPOT_COLOURS = {
    "hot": ["#fddbc7", "#ef8a62", "#b2182b"],
    "cold": ["#d1e5f0", "#67a9cf", "#2166ac"],
}
NONE_COLOUR = "#f7f7f7"
# End points of the count gradient (RGB).
GRADIENT_MIN = (251, 248, 179)
GRADIENT_MAX = (248, 105, 107)


def local_gstar(values: DataFrame, edges: DataFrame, value: str = "value", id_col: str = "id",
                params: list[float] | None = None, param_col: str = "param") -> DataFrame:
    """Z of Getis-Ord G*_i per node:
    Z = (S_i - W_i * mean) / (s * sqrt((n * W_i - W_i^2) / (n - 1))), with
    S_i the sum of values over the neighbours and the node itself, W_i their
    count and s the population standard deviation. Per-node sums are one
    grouped aggregate over the edges; the node's own value is added after the
    join. With ``params`` the edges carry ``param_col`` and every node gets one
    row per parameter (islands included). p_norm is one-sided: 1 - Phi(|Z|).
    """
    keys = [param_col] if params is not None else []
    st = values.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    v = values.select(F.col(id_col).alias("dst"), F.col(value).alias("__v"))
    nb = edges.select(*keys, "src", "dst").join(v, "dst")
    sums = nb.groupBy(*keys, "src").agg(F.sum("__v").alias("__s"), F.count(F.lit(1)).alias("__w"))
    return _gstar_of_sums(values, sums, st, value, id_col, params, param_col, keys)


def band_gstar(values: DataFrame, bands: list[float], value: str = "value", id_col: str = "id", param_col: str = "param") -> DataFrame:
    """``local_gstar`` of ``band_family`` edges without a table of edges."""
    st = values.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    own = values.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__rows"), F.sum(value).alias("__sum"))
    pts = values.select(F.col(id_col).alias("__id"), "x", "y").join(own, "__id")
    sums = per_id(neighbour_sums(pts, bands, {"__s": (0, F.col("__sum")), "__w": (0, F.col("__rows"))}, "__id", param=param_col), "__s", "__w", param=param_col)
    return _gstar_of_sums(values, sums.withColumnRenamed("id", "src"), st, value, id_col, bands, param_col, [param_col])


def _gstar_of_sums(values, sums, st, value, id_col, params, param_col, keys):
    n, m, s = float(st["n"]), st["m"], st["s"]
    node = values.select(F.col(id_col).alias("src"), F.col(value).alias("__self"))
    if params is not None:
        node = node.withColumn(param_col, F.explode(F.array(*[F.lit(float(p)) for p in params])))
    j = node.join(sums, [*keys, "src"], "left")
    W = F.coalesce(F.col("__w"), F.lit(0)).cast("double") + F.lit(1.0)
    S = F.coalesce(F.col("__s"), F.lit(0.0)) + F.col("__self")
    # try_divide: a constant value (s = 0) or a node linked to every other
    # node (n W = W^2) has no defined Z; null instead of an ANSI error
    z = F.try_divide(S - W * F.lit(m), F.lit(s) * F.sqrt((F.lit(n) * W - W * W) / F.lit(n - 1.0)))
    out = j.select(*keys, F.col("src").alias(id_col), F.col("__self").alias(value), z.alias("Zs"))
    return out.withColumn("p_norm", normal_sf(F.abs(F.col("Zs"))))


def classify_spots(g: DataFrame, alpha: float = 0.05) -> DataFrame:
    """spot = hot (p < alpha, Z > 0), cold (p < alpha, Z < 0) or 'None';
    sig_lvl = -1..2 for p thresholds 0.05, 0.01, 0.001."""
    sig = F.col("p_norm") < alpha
    spot = F.when(sig & (F.col("Zs") > 0), "hot").when(sig & (F.col("Zs") < 0), "cold").otherwise("None")
    return g.withColumn("spot", spot).withColumn("sig_lvl", sig_level("p_norm"))


def spot_colour(g: DataFrame) -> DataFrame:
    """Colour by (spot, significance level)."""
    hot = F.array(*[F.lit(c) for c in SPOT_COLOURS["hot"]])
    cold = F.array(*[F.lit(c) for c in SPOT_COLOURS["cold"]])
    lvl = F.greatest(F.col("sig_lvl"), F.lit(0))
    colour = (F.when(F.col("spot") == "hot", F.element_at(hot, lvl + 1))
              .when(F.col("spot") == "cold", F.element_at(cold, lvl + 1))
              .otherwise(F.lit(NONE_COLOUR)))
    return g.withColumn("color", colour)


def gradient_colour(df: DataFrame, count_col: str, log_: bool = True) -> DataFrame:
    """'#rrggbb' on a linear gradient by count / max(count) (log(count+1) by
    default); channels truncated to int. The max is one aggregate value."""
    v = F.log(F.col(count_col) + F.lit(1.0)) if log_ else F.col(count_col).cast("double")
    mx = df.agg(F.max(v)).first()[0]
    pct = F.try_divide(v, F.lit(mx))
    ch = [(F.lit(float(a)) + F.lit(float(b - a)) * pct).cast("int") for a, b in zip(GRADIENT_MIN, GRADIENT_MAX)]
    return df.withColumn("color", F.format_string("#%02x%02x%02x", *ch))


def spot_counts(g: DataFrame, by: str = "param") -> DataFrame:
    """Hot, cold and total significant counts per band."""
    sig = F.col("p_norm") < 0.05
    return g.groupBy(by).agg(
        F.count(F.when(sig, 1)).alias("total"),
        F.count(F.when(sig & (F.col("Zs") > 0), 1)).alias("hot"),
        F.count(F.when(sig & (F.col("Zs") < 0), 1)).alias("cold"))
