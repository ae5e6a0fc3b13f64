"""How the driver's test tables play the reference's data shapes.

* segment population and type  <- customer (c_custkey, c_mktsegment)
* monthly feature tables       <- orders per customer and month (status columns),
                                  lineitem quantities per return flag via orders
* static feature table         <- customer account balance
* rating / label               <- leading digit of o_orderpriority (1..5)
* points and value             <- embeddings: x = embedding[0], y = embedding[1], value = label
* truth and prediction         <- binned mean rating vs binned mean rating of odd order keys
* run result table             <- customer x seed with a deterministic integer score

Every frame is a lazy projection of the parquet scan, so column pruning and
filters reach the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round
from segstats.session import dealt

KEY = "index_seg"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment population: (index_seg, name) with ``name`` the segment type."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(KEY), F.col("c_mktsegment").alias("name"))


def year_range(ts: str, years) -> F.Column:
    """Range predicate on the raw timestamp covering ``years``: unlike
    year(ts) IN (...), it reaches the parquet reader (row-group skipping)."""
    lo, hi = min(years), max(years) + 1
    return (F.col(ts) >= F.lit(f"{lo}-01-01").cast("timestamp_ntz")) & \
        (F.col(ts) < F.lit(f"{hi}-01-01").cast("timestamp_ntz"))


def monthly_orders(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Monthly feature table, one row per order: (index_seg, YEAR, MONTH,
    orders_F, orders_O, orders_P, orders_total). Status columns are null when
    the order has another status, like a sparse event count. ``years``
    pre-filters the scan by a pushable date range (the exact YEAR filter is
    still applied by ``filter_year``)."""
    o = table(spark, sf_dir, "orders")
    if years:
        o = o.filter(year_range("o_orderdate", years))
    cols = [F.when(F.col("o_orderstatus") == s, F.lit(1.0)).alias(f"orders_{s}") for s in ("F", "O", "P")]
    return o.select(F.col("o_custkey").alias(KEY),
                    F.year("o_orderdate").alias("YEAR"), F.month("o_orderdate").alias("MONTH"),
                    *cols, F.lit(1.0).alias("orders_total"))


def monthly_items(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Monthly feature table from lineitem: (index_seg, YEAR, MONTH, qty_A, qty_N, qty_R)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if years:
        o = o.filter(year_range("o_orderdate", years))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    cols = [F.when(F.col("l_returnflag") == s, F.col("l_quantity")).alias(f"qty_{s}") for s in ("A", "N", "R")]
    return j.select(F.col("o_custkey").alias(KEY),
                    F.year("o_orderdate").alias("YEAR"), F.month("o_orderdate").alias("MONTH"), *cols)


def static_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static feature table (no YEAR): (index_seg, acctbal)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY),
                                                   F.col("c_acctbal").alias("acctbal"))


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual ratings: (index_seg, o_orderkey, rating 1..5, o_orderstatus)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias(KEY), "o_orderkey", "o_orderstatus", "o_orderdate",
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous label per segment: mean rating, (index_seg, csl) in 1..5."""
    return order_ratings(spark, sf_dir).groupBy(KEY).agg(F.avg("rating").alias("csl"))


def truth_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_seg, model, y_true, y_pred, y_raw): truth = binned mean rating;
    raw prediction = mean rating of the odd order keys (0 when there is none),
    binned the same way; ``model`` = the customer's market segment."""
    r = order_ratings(spark, sf_dir)
    agg = r.groupBy(KEY).agg(
        F.avg("rating").alias("y_true_raw"),
        F.coalesce(F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.col("rating"))), F.lit(0.0)).alias("y_raw"))
    seg = segments(spark, sf_dir).select(KEY, F.col("name").alias("model"))
    return agg.join(seg, KEY).select(
        KEY, "model",
        bounded_round("y_true_raw", 1, 5).alias("y_true"),
        bounded_round("y_raw", 1, 5).alias("y_pred"),
        "y_raw")


def truth_pred_seeds(spark: SparkSession, sf_dir: str, n_seeds: int = 10) -> DataFrame:
    """(index_seg, seed, y_true, y_pred): per seed s the prediction is the
    binned mean rating of the orders with (o_orderkey + s) % 3 == 0."""
    # the hits of a seed depend on seed % 3 alone: orders are aggregated per key first, and the seeds are
    # spelled out of that, so a task holds one row per key and not one per key and seed
    r = order_ratings(spark, sf_dir)
    hits = [F.avg(F.when((F.col("o_orderkey") + s) % 3 == 0, F.col("rating"))).alias(f"r{s}") for s in range(3)]
    per_key = r.groupBy(KEY).agg(F.avg("rating").alias("t"), *hits)
    agg = per_key.select(KEY, "t", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seed"), F.coalesce(F.col(f"r{s % 3}"), F.lit(0.0)).alias("r")) for s in range(n_seeds)])).alias("s")
    ).select(KEY, "t", "s.*")
    return agg.select(KEY, "seed", bounded_round("t", 1, 5).alias("y_true"), bounded_round("r", 1, 5).alias("y_pred"))


def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_seg, acctbal, n_orders, avg_price): a few numeric features."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias(KEY)).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    return static_account(spark, sf_dir).join(o, KEY, "left")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar points with a value: (id, x, y, value)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"),
                    F.col("label").cast("double").alias("value"))


def point_features(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """Points with several feature columns f0..f{n-1} = embedding[2..] (for
    Moran grids and neighbour averages over many columns)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"),
                    F.col("label").cast("double").alias("value"),
                    *[F.col("embedding")[2 + i].cast("double").alias(f"f{i}") for i in range(n)])


def run_results(spark: SparkSession, sf_dir: str, n_seeds: int = 10) -> DataFrame:
    """Experiment run table: one row per customer x seed.

    kind = regression for even nation keys else classification; model_name =
    market segment; ftr_combo_name = 'set<nation mod 5>'; feature_selection =
    '' or 'mrmr' by customer parity; upsample = '' or 'smote'. Scores are
    integer formulas in (customer, seed) scaled to [0, 1).
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # sorts and writes of the runs take a whole task's rows: the customers are dealt before the seeds are spelled out
    r = dealt(c, n_seeds).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("seed"))
    k = F.col("c_custkey")
    s = F.col("seed").cast("long")
    return r.select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "reg").otherwise("cls").alias("kind"),
        F.col("c_mktsegment").alias("model_name"),
        F.concat(F.lit("set"), (F.col("c_nationkey") % 5).cast("string")).alias("ftr_combo_name"),
        F.when(k % 2 == 0, "").otherwise("mrmr").alias("feature_selection"),
        F.when(k % 3 == 0, "smote").otherwise("").alias("upsample"),
        F.col("seed"),
        ((k * 7 + s * 13) % 101 / 100.0).alias("test_f1_micro"),
        ((k * 11 + s * 3) % 97 / 100.0).alias("test_f1_macro"),
        ((k * 5 + s * 17) % 89 / 100.0).alias("test_f1_weighted"),
        ((k * 3 + s * 7) % 83 / 100.0).alias("train_f1_micro"),
        ((k * 13 + s * 5) % 79 / 50.0).alias("test_mse"),
    )
