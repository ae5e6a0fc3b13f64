"""Labels: weighted mean ratings, subgroup labels, re-levelling, rounding modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round, broadcast_if_small, half_even_round, relevel

KEY = "index_seg"


def weighted_rating(ratings: DataFrame, scheme: DataFrame, attr: str, rating: str = "rating",
                    key: str = KEY, max_scheme_rows: int = 100_000) -> DataFrame:
    """Label per segment = sum(w * r) / sum(w) with ``w`` looked up from the
    weighting scheme (attr value -> weight). Attribute values missing from the
    scheme get weight 1. The scheme is a small table, broadcast when bounded."""
    s = broadcast_if_small(scheme.select(F.col(attr), F.col("weight").cast("double")), max_scheme_rows)
    j = ratings.join(s, attr, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return j.groupBy(key).agg(F.try_divide(F.sum(F.col("weight") * F.col(rating)), F.sum("weight")).alias("csl"))


def rating_by_subgroup(ratings: DataFrame, attrs: list[str], rating: str = "rating", key: str = KEY) -> DataFrame:
    """One label per (question q, answer a, segment): the respondent attributes
    are unpivoted to (q, a) rows, then averaged per group in one aggregate."""
    long = ratings.select(key, rating, F.explode(F.array(*[
        F.struct(F.lit(c).alias("q"), F.col(c).cast("string").alias("a")) for c in attrs])).alias("qa"))
    return long.groupBy("qa.q", "qa.a", key).agg(F.avg(rating).alias("csl")).select("q", "a", key, "csl")


def relevel_labels(df: DataFrame, levels: int, col: str = "csl", top: int = 5) -> DataFrame:
    return df.withColumn(col, relevel(col, levels, top))


def round_labels(df: DataFrame, col: str = "csl", how: str = "bounded", lo: float = 1, hi: float = 5,
                 out: str = "y_class") -> DataFrame:
    """``bounded`` (equal-width bins of the reference) or ``half_even``."""
    expr = bounded_round(col, lo, hi) if how == "bounded" else half_even_round(col)
    return df.withColumn(out, expr)


def label_mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value; ties go to the smallest value (first mode)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("mode"))
