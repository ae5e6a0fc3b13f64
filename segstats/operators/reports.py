"""Report tables over run results: means and spreads, pivots, ordering,
top-n, unions, histograms, exact quantiles, correlations, tags and run plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segstats.functions.expressions import fixed_decimals
from segstats.operators.metrics import value_counts_ranked, value_ranges
from segstats.session import cut_lineage


def mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample standard deviation (ddof = 1) per key."""
    aggs = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return df.groupBy(*keys).agg(*aggs)


def nested_mean(df: DataFrame, keys: list[str], sample: str, metrics: list[str]) -> DataFrame:
    """Two stages: per (keys, sample) mean and std, then the mean of the means
    and the std of the stds over samples."""
    s1 = df.groupBy(*keys, sample).agg(*[x for m in metrics for x in (
        F.avg(m).alias(f"{m}_m"), F.stddev_samp(m).alias(f"{m}_s"))])
    return s1.groupBy(*keys).agg(*[x for m in metrics for x in (
        F.avg(f"{m}_m").alias(f"{m}_mean"), F.stddev_samp(f"{m}_s").alias(f"{m}_std"))])


def pivot_metric(df: DataFrame, row: str, col: str, value: str, values: list[str]) -> DataFrame:
    """Rows x listed column values of a (mean) metric; listing the values keeps
    it one job (no distinct pass)."""
    means = df.groupBy(row, col).agg(F.avg(value).alias("__v"))
    return means.groupBy(row).pivot(col, values).agg(F.first("__v"))


def with_order(df: DataFrame, col: str, order: list[str], out: str = "row_order") -> DataFrame:
    """Attach the position of ``col`` in a fixed order (missing -> null) and sort."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col)).cast("int")
    return df.withColumn(out, F.when(pos > 0, pos)).orderBy(F.col(out).asc_nulls_last(), col)


def add_baseline_row(pivoted: DataFrame, row: str, label: str, value: float) -> DataFrame:
    """Append a baseline row whose value is repeated in every metric column."""
    cols = [c for c in pivoted.columns if c != row]
    base = pivoted.sparkSession.range(1).select(F.lit(label).alias(row), *[F.lit(float(value)).alias(c) for c in cols])
    return pivoted.unionByName(base)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Global top n (TakeOrderedAndProject: per-partition top n, then merge)."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int, rank_col: str = "rank") -> DataFrame:
    """Top n rows per group by ``row_number``; the rank filter lets Spark insert
    a partial WindowGroupLimit before the shuffle, so a huge group sends only n
    rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def union_runs(frames: list[DataFrame], fill: str = "") -> DataFrame:
    """Union by name; columns missing in a frame are filled with ''."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    strings = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.na.fill(fill, subset=strings)


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by: list[str] = ()) -> DataFrame:
    """Equal-width histogram; the top edge belongs to the last bin."""
    b = F.least(F.width_bucket(F.col(col), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(col).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, value: str, by: list[str], qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group without gathering a group:
    the wanted positions find their range among the range sizes (``value_ranges``, a small
    table), then the values of that range only."""
    by = list(by)
    if not by:
        return exact_quantiles(df.withColumn("__g", F.lit(0)), value, ["__g"], qs).drop("__g")
    ranges = value_ranges(df.select(*by, value), by, value)
    ranked = cut_lineage(value_counts_ranked(df, by, value, ranges=ranges))
    sizes = ranges[1]
    n = sizes.groupBy(*by).agg(F.sum("__size").alias("__n"))
    pos = n.select(*by, F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), ((F.col("__n") - 1) * F.col("q")).alias("__h"))
    pos = pos.select(*by, "q", "__h", F.explode(F.array_distinct(F.array(F.floor("__h"), F.ceil("__h")))).alias("__at"))

    def same(a: DataFrame, b: DataFrame, cols: list[str]) -> list:
        return [a[c].eqNullSafe(b[c]) for c in cols]

    pos = cut_lineage(pos.join(sizes, same(pos, sizes, by)).filter(F.col("__at").between(F.col("__off"), F.col("__off") + F.col("__size") - 1))
                      .select(*[pos[c] for c in by], "q", "__h", "__at", "__range"))
    hit = pos.join(ranked, same(pos, ranked, [*by, "__range"])).filter(
        (F.col("before") <= F.col("__at")) & (F.col("__at") < F.col("before") + F.col("cnt"))).select(
        *[pos[c] for c in by], "q", "__h", "__at", value)
    return hit.groupBy(*by, "q").agg(F.min_by(F.col(value).cast("double"), "__at").alias("__lo"), F.max_by(F.col(value).cast("double"), "__at").alias("__hi"),
                                     F.first(F.col("__h") - F.floor("__h")).alias("__part")).select(
        *by, "q", (F.col("__lo") + F.col("__part") * (F.col("__hi") - F.col("__lo"))).alias("value"))


def pearson(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """r, n and t = r * sqrt((n - 2) / (1 - r^2)) per feature in one pass."""
    row = df.agg(*[x for i, c in enumerate(features) for x in (
        F.corr(c, target).alias(f"r{i}"),
        F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1)).alias(f"n{i}"))])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(features)])).alias("s")).select("s.*")
    return long.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r"))))


def pearson_with_p(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson r with two-sided Student-t p and significance stars. The p
    values come from an Arrow-batched pandas UDF over the small per-feature
    result (one row per feature)."""
    from segstats.functions.pvalues import t_test_p

    r = pearson(df, features, target).withColumn("p", t_test_p("t", "n"))
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return r.withColumn("stars", stars)


def agreement(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Share of rows where two metrics are equal."""
    return df.groupBy(*by).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def run_key(cols: list[str]) -> F.Column:
    """Space-joined run key that keeps blank parts (like the reference's format string)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def display_names(col: str, mapping: dict[str, str], split_on: str | None = None) -> F.Column:
    """Lookup of display names; unknown keys keep their own text. With
    ``split_on`` the key is the text before the first separator."""
    key = F.split(F.col(col), split_on, 2)[0] if split_on else F.col(col)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), key)


def best_per_scheme(means: DataFrame, scheme: str, label_cols: list[str], metric: str, n: int = 3) -> DataFrame:
    """Top n label combinations per scheme by the metric, as 'a b 0.123; ...'
    text plus the best value."""
    ranked = top_n_per_group(means, [scheme], [F.desc(metric), *label_cols], n, "__r")
    piece = F.concat_ws(" ", *[F.col(c) for c in label_cols], fixed_decimals(metric, 3))
    agg = ranked.groupBy(scheme).agg(
        F.max(metric).alias("max_"),
        F.array_sort(F.collect_list(F.struct(F.col("__r"), piece.alias("s")))).alias("__parts"))
    return agg.select(scheme, "max_", F.array_join(F.transform("__parts", lambda x: x["s"]), "; ").alias("str"))


def pending_runs(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs without a result yet (resume): left anti join on the run keys."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def run_plan(axes: dict, allow: DataFrame | None = None, spark=None) -> DataFrame:
    """Cartesian plan of parameter axes, built by exploding one small row of
    arrays. An axis is a list of values or a frame whose first column's
    distinct values form the axis. An allow-list restricts the plan by a semi
    join on the columns it shares with the plan."""
    for ax in axes.values():
        if isinstance(ax, DataFrame):
            spark = ax.sparkSession
            break
    row = None
    for name, ax in axes.items():
        if isinstance(ax, DataFrame):
            one = ax.agg(F.array_sort(F.collect_set(F.col(ax.columns[0]))).alias(name))
        else:
            one = spark.range(1).select(F.array(*[F.lit(v) for v in ax]).alias(name))
        row = one if row is None else _zip_rows(row, one)
    out = row
    for name in axes:
        out = out.withColumn(name, F.explode(name))
    if allow is not None:
        out = out.join(allow, [c for c in allow.columns if c in out.columns], "left_semi")
    return out


def _zip_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two one-row frames column-wise (equi-join on a constant key)."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")
