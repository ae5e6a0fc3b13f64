"""Feature-table assembly: year / total filters, per-segment sums, population
joins, dense-column selection, group-mean imputation and the N-way join.

All operators are DataFrame -> DataFrame; the only driver-side values are
column names and one row of per-column statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.expressions import broadcast_if_small, row_sum
from segstats.session import cut_lineage, small_or_written

KEY = "index_seg"
TIME_COLS = ("YEAR", "MONTH")


def value_columns(df: DataFrame, key: str = KEY, exclude: tuple[str, ...] = TIME_COLS) -> list[str]:
    return [c for c in df.columns if c != key and c not in exclude]


def filter_year(df: DataFrame, years, keep_year: bool = False) -> DataFrame:
    """Keep rows whose YEAR is in ``years`` and drop YEAR / MONTH; tables without
    a YEAR column pass untouched. A YEAR derived from a timestamp is not pushed: give
    the scan the same window as a range on the timestamp (``testdata.year_range``)."""
    if "YEAR" not in df.columns:
        return df
    out = df.filter(F.col("YEAR").isin([int(y) for y in years]))
    if keep_year:
        return out
    return out.drop(*[c for c in TIME_COLS if c in out.columns])


def filter_total(df: DataFrame, name: str, how: str = "NO_TOTAL", key: str = KEY) -> DataFrame:
    """NO_TOTAL: value columns whose name lacks 'total'. TOTAL: those containing
    'total'; when there is none, ``<name>_total`` = null-skipping row sum of the
    value columns (YEAR / MONTH never enter the sum)."""
    if how not in ("NO_TOTAL", "TOTAL"):
        raise ValueError("how must be NO_TOTAL or TOTAL")
    vals = value_columns(df, key)
    keep_time = [c for c in TIME_COLS if c in df.columns]
    if how == "NO_TOTAL":
        chosen = [F.col(c) for c in vals if "total" not in c]
    else:
        totals = [c for c in vals if "total" in c]
        chosen = [F.col(c) for c in totals] if totals else [row_sum(vals).alias(f"{name}_total")]
    return df.select(key, *keep_time, *chosen)


def sum_per_segment(df: DataFrame, key: str = KEY) -> DataFrame:
    """Sum every value column per segment (partial + final hash aggregate).
    An all-null group stays null so the density filter can still see it."""
    vals = value_columns(df, key, exclude=())
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in vals])


def left_population(pop: DataFrame, feat: DataFrame, key: str = KEY) -> DataFrame:
    """Every segment of the population, with nulls where the table has no row."""
    return pop.join(feat, key, "left")


def semi_segments(pop: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """Restrict the population to ids present in ``ids`` (EXISTS)."""
    return pop.join(ids.select(key), key, "left_semi")


def non_null_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pass: share of non-null values per column, long form (column, share)."""
    n = F.count(F.lit(1))
    wide = df.agg(*[F.try_divide(F.count(c), n).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("share")) for c in cols
    ])).alias("s")).select("s.*")


def keep_dense_columns(df: DataFrame, cols: list[str], thres: float = 0.1) -> list[str]:
    """Columns whose non-null share over the rows of ``df`` is >= ``thres``.
    Only a single row of statistics reaches the driver."""
    if not cols:
        return []
    row = df.agg(*[F.try_divide(F.count(c), F.count(F.lit(1))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and row[f"s{i}"] >= thres]


def fill_group_mean(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Replace nulls with the mean of the same group (segment type).

    The means are one aggregate (one row per group), read first: a few rows are
    broadcast, so the wide table is not shuffled on a few group values (many are a
    written table, joined by its size).
    """
    if not cols:
        return df
    means = small_or_written(df.groupBy(group).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols]))
    j = df.join(means, group, "left")
    out = [F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    return j.select(*out)


def fill_constant(df: DataFrame, value: float = 0.0, cols: list[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=cols) if cols else df.na.fill(value)


def prepare_table(df: DataFrame, name: str, years, how: str | None, key: str = KEY) -> DataFrame:
    """Year filter -> optional total filter -> sum per segment."""
    t = filter_year(df, years)
    if how is not None:
        t = filter_total(t, name, how, key)
    if "YEAR" not in df.columns:
        return t  # static table: already one row per segment
    return sum_per_segment(t, key)


def join_features(pop: DataFrame, tables: dict[str, DataFrame], years, how: str = "NO_TOTAL",
                  totals: tuple[str, ...] = (), group_fill: tuple[str, ...] = (),
                  drop_na_thres: float = 0.1, key: str = KEY, type_col: str = "name",
                  return_catalogue: bool = False, materialize: bool = True):
    """Assemble the wide feature matrix.

    Per table: year filter, total filter (only tables named in ``totals``), sum
    per segment. All tables are then left-joined onto the population in one
    chain: every side is aggregated on ``key`` so the joins share one hash
    partitioning. Columns with a non-null share under ``drop_na_thres`` are
    dropped (one statistics pass), tables in ``group_fill`` get the mean of the
    segment type, and the remaining nulls become 0.
    """
    prepared = {n: prepare_table(t, n, years, how if n in totals else None, key) for n, t in tables.items()}
    wide = reduce(lambda acc, t: acc.join(t, key, "left"), prepared.values(), pop.select(key, type_col))
    # one row per segment from here on: materialise it once in the checkpoint
    # folder so the statistics pass and the output do not both re-aggregate
    # the raw event tables
    if materialize:
        wide = cut_lineage(wide)
    cols_by_table = {n: value_columns(t, key) for n, t in prepared.items()}
    all_cols = [c for cs in cols_by_table.values() for c in cs]
    kept = set(keep_dense_columns(wide, all_cols, drop_na_thres))
    catalogue = {n: [c for c in cs if c in kept] for n, cs in cols_by_table.items()}
    fill_cols = [c for n in group_fill for c in catalogue.get(n, [])]
    wide = fill_group_mean(wide, type_col, fill_cols)
    ordered = [c for cs in catalogue.values() for c in cs]
    out = wide.select(key, *ordered).na.fill(0.0, subset=ordered)
    return (out, catalogue) if return_catalogue else out


def catalogue_frame(spark, catalogue: dict[str, list[str]]) -> DataFrame:
    """Feature catalogue as a table (feature_type, column, pos); ``pos`` is the
    global position in catalogue order."""
    rows = [(t, c) for t, cs in catalogue.items() for c in cs]
    rows = [(t, c, i) for i, (t, c) in enumerate(rows)]
    return spark.createDataFrame(rows, "feature_type string, column string, pos int")


def select_family(df: DataFrame, catalogue: DataFrame, families: list[str], key: str = KEY) -> DataFrame:
    """Keep the columns of the named feature families in catalogue order."""
    cols = [r["column"] for r in catalogue.filter(F.col("feature_type").isin(families))
            .orderBy("pos").select("column").collect()]
    return df.select(key, *cols)


def rare_category_other(df: DataFrame, col: str, threshold: int = 20, other: str = "OTHER",
                        max_categories: int = 1_000_000) -> DataFrame:
    """Categories seen at most ``threshold`` times become ``other``.
    Counts are a grouped aggregate joined back (broadcast when bounded)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    counts = broadcast_if_small(counts, max_categories)
    j = df.join(counts, col, "left")
    return j.select(*[F.when(F.col("__n") <= threshold, F.lit(other)).otherwise(F.col(col)).alias(col)
                      if c == col else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, col: str, prefix: str | None = None, max_values: int = 10_000) -> DataFrame:
    """``pd.get_dummies`` for one column: one 0/1 column ``<col>_<value>`` per
    distinct value, sorted by value; the source column is replaced.
    The distinct values are bounded metadata (checked against ``max_values``)."""
    prefix = prefix or col
    values = [r[0] for r in df.select(F.col(col).cast("string")).distinct().limit(max_values + 1).collect()
              if r[0] is not None]
    if len(values) > max_values:
        raise ValueError(f"{col} has more than {max_values} distinct values")
    values.sort()
    dummies = [(F.col(col).cast("string") == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in values]
    return df.select(*[F.col(c) for c in df.columns if c != col], *dummies)


def encode_columns(df: DataFrame, name: str, key: str = KEY) -> DataFrame:
    """Rename value columns to ``<name>_000``, ``<name>_001``, ..."""
    vals = [c for c in df.columns if c != key]
    return df.withColumnsRenamed({c: f"{name}_{i:03d}" for i, c in enumerate(vals)})


def label_clean(df: DataFrame, label: str = "LTS", invalid: int = 10) -> DataFrame:
    """Drop invalid ordinal labels and rows with any null."""
    return df.filter(F.col(label) != invalid).na.drop()


def zero_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sparsity: share of exact zeros per column, long form (col, pcnt) in %.
    One aggregate pass over all columns."""
    wide = df.agg(*[(F.avg((F.col(c) == 0).cast("double")) * 100.0).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("pcnt")) for c in cols])).alias("s")).select("s.*")


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls -> column mean. The means are one aggregate row (p numbers) that
    reaches the driver as literals; no join, no shuffle of the data."""
    if not cols:
        return df
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    fills = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills and fills[c] is not None
                       else F.col(c) for c in df.columns])


def keep_report(df: DataFrame, cols: list[str], thres: float = 0.1) -> DataFrame:
    """Kept / removed feature report: (column, share, kept)."""
    return non_null_shares(df, cols).withColumn("kept", F.col("share") >= F.lit(thres))
