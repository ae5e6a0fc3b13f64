"""Seeded, exact, distributed ranking and everything built on it: 80/20 splits,
k folds, stratified folds, exact-size samples, under- and upsampling.

Randomness is a portable integer hash of (id, seed) (see
``segstats.functions.expressions.portable_hash``), so every engine reproduces
the same order. Ranks are computed without a global or per-class single-task
window: rows are spread over hash buckets, bucket sizes are counted (a small
table), offsets are prefix sums over that small table, and ``row_number`` runs
inside each bounded bucket. A class holding a third of all rows is therefore
still split over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.functions.expressions import HASH_P, broadcast_if_small, portable_hash
from segstats.session import cut_lineage

KEY = "index_seg"
BUCKET_ROWS = 20_000  # rows ranked together


def hash_rank(df: DataFrame, id_col: str, seed, by: tuple[str, ...] | list[str] = (),
              n_buckets: int | None = None, rank_col: str = "rank", n_col: str = "n") -> DataFrame:
    """Add the exact 1-based rank of each row within its ``by`` group in the
    order of (portable_hash(id, seed), id), plus the group size ``n``.

    ``seed`` is an int or a column (rank many seeds in one pass with
    ``by=("seed",)``). Rows go to ``n_buckets`` hash ranges (default: the row
    count over ``BUCKET_ROWS``); bucket sizes are counted into a table of one row
    per (group, bucket) whose prefix sums give each bucket's offset;
    ``row_number`` then runs inside each bucket only.
    """
    by = list(by)
    if n_buckets is None:
        n_buckets = max(1, -(-df.count() // BUCKET_ROWS))
    h = df.withColumn("__h", portable_hash(id_col, seed))
    h = h.withColumn("__b", F.floor(F.col("__h") * F.lit(float(n_buckets)) / F.lit(float(HASH_P))).cast("long"))
    counts = h.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w_off = Window.partitionBy(*by).orderBy("__b") if by else Window.orderBy("__b")
    offsets = counts.select(
        *by, "__b",
        (F.sum("__c").over(w_off) - F.col("__c")).alias("__off"),
        F.sum("__c").over(Window.partitionBy(*by) if by else Window.partitionBy()).alias(n_col))
    # at most rows / BUCKET_ROWS x groups rows: AQE broadcasts it when its measured size allows
    j = h.join(offsets, [*by, "__b"], "inner")
    w = Window.partitionBy(*by, "__b").orderBy("__h", id_col)
    return j.withColumn(rank_col, (F.col("__off") + F.row_number().over(w)).cast("long")).drop("__h", "__b", "__off")


def split_80_20(df: DataFrame, seed: int, id_col: str = KEY, test_size: float = 0.2) -> DataFrame:
    """Exact split: the first ceil(test_size * n) rows in hash order are test.
    Adds ``part`` ('train' / 'test')."""
    r = hash_rank(df, id_col, seed)
    is_test = F.col("rank") <= F.ceil(F.col("n") * F.lit(test_size))
    return r.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("rank", "n")


def split_seeds(df: DataFrame, seeds: list[int], id_col: str = KEY, test_size: float = 0.2) -> DataFrame:
    """Split table (seed, id, part) for several seeds, ranked in one pass."""
    x = df.select(id_col, F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed"))
    r = hash_rank(x, id_col, F.col("seed"), by=("seed",))
    is_test = F.col("rank") <= F.ceil(F.col("n") * F.lit(test_size))
    return r.select("seed", id_col, F.when(is_test, "test").otherwise("train").alias("part"))


def ntile_expr(rank: str, n: str, k: int) -> F.Column:
    """0-based ``ntile(k)`` of a 1-based rank among n rows (larger chunks first,
    like ``numpy.array_split``)."""
    r, nn = F.col(rank), F.col(n)
    q = F.floor(nn / k)
    m = nn - q * k
    big = m * (q + 1)
    return F.when(r <= big, F.floor((r - 1) / (q + 1))).otherwise(m + F.floor((r - 1 - big) / q)).cast("int")


def k_fold(df: DataFrame, seed: int, k: int = 5, id_col: str = KEY) -> DataFrame:
    """Shuffled k-fold assignment (``fold`` 0..k-1), unequal sizes allowed."""
    r = hash_rank(df, id_col, seed)
    return r.withColumn("fold", ntile_expr("rank", "n", k)).drop("rank", "n")


def stratified_folds(df: DataFrame, label: str, seed: int, k: int = 5, id_col: str = KEY) -> DataFrame:
    """Fold = (rank within class - 1) mod k: every class spread evenly over folds."""
    r = hash_rank(df, id_col, seed, by=(label,))
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n")


def sample_exact(df: DataFrame, frac: float, seed: int, id_col: str = KEY) -> DataFrame:
    """Exactly round_half_even(frac * n) rows, chosen by hash order."""
    r = hash_rank(df, id_col, seed)
    return r.filter(F.col("rank") <= F.bround(F.col("n") * F.lit(frac), 0)).drop("rank", "n")


def undersample(df: DataFrame, label: str, seed: int, id_col: str = KEY) -> DataFrame:
    """Random undersampling: every class cut to the size of the smallest class."""
    # class sizes are a partial aggregate (cheap); ranks are computed once
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).agg(F.min("__n")).first()[0]
    r = hash_rank(df, id_col, seed, by=(label,))
    return r.filter(F.col("rank") <= F.lit(smallest)).drop("rank", "n")


def naive_upsample(df: DataFrame, label: str, max_classes: int = 100_000) -> DataFrame:
    """Repeat each class's rows round_half_even(max_count / count) times; adds
    ``copy`` (1..factor). Class counts are a small aggregate joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n")).first()[0]
    factors = counts.select(label, F.bround(F.lit(float(top)) / F.col("__n"), 0).cast("int").alias("__k"))
    factors = broadcast_if_small(factors, max_classes)
    j = df.join(factors, label, "inner")
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__k")


def ordered_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based position of each row in the order of ``order``: rows are sorted by
    range partitions, whose sizes (one row per partition) give the offsets."""
    part = cut_lineage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    n = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    off = n.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__o"))
    w = Window.partitionBy("__p").orderBy(*order)
    return part.join(cut_lineage(off), "__p").withColumn(out, F.col("__o") + F.row_number().over(w) - 1).drop("__p", "__o")


def lookup(x: DataFrame, ids: DataFrame, order: list[str], id_col: str = KEY, out: str = "position") -> DataFrame:
    """Rows of ``x`` for an id list that may repeat ids: one row per list entry with
    its position in the list (the list's order is given by ``order``)."""
    return ordered_position(ids, order, out).join(x, id_col, "inner")


def _uniform(key: F.Column, salt: int) -> F.Column:
    """Deterministic uniform [0, 1) from an integer key and a salt."""
    return portable_hash(key, salt).cast("double") / F.lit(float(HASH_P))


def _samples(need: DataFrame, label: str, block: int = 10_000) -> DataFrame:
    """One row per synthetic sample (label, __m, __s = 0..need - 1): the deficit is
    cut into blocks, which are shuffled before each is spelled out."""
    blocks = need.select(label, "__m", "__need", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("__need") - 1) / block).cast("long"))).alias("__b"))
    start = F.col("__b") * block
    return blocks.repartition(label, "__b").select(label, "__m", F.explode(F.sequence(
        start, F.least(start + block, F.col("__need")) - 1)).alias("__s"))


def smote(df: DataFrame, label: str, features: list[str], seed: int = 10, k: int = 5,
          id_col: str = KEY, grid: tuple[str, str] | None = None, seeds_filter: F.Column | None = None) -> DataFrame:
    """SMOTE (regular): every class with at least k + 1 rows is topped up to
    the size of the largest class with synthetic rows a + lambda * (b - a),
    a drawn uniformly from the class (or from the rows passing
    ``seeds_filter``, e.g. support vectors), b one of a's k nearest
    neighbours in the class, lambda uniform in [0, 1). Classes with k rows or
    fewer cannot be interpolated and are left as they are.

    Everything is joins on keys: exact within-class KNN (grid ring search on
    two feature columns, distance over all), a per-class ranking of the seed
    rows, and one generated row per synthetic sample; random choices are
    portable hashes of (sample number, seed). Output: original rows plus
    synthetic ones, with ``synthetic`` (bool); synthetic ids are null.
    """
    from segstats.operators.spatial.weights import knn
    # the input feeds counts, ranking, the KNN rounds and both feature lookups
    df = cut_lineage(df)
    gx, gy = grid or (features[0], features[1] if len(features) > 1 else features[0])
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n")).first()[0]
    pool = df if seeds_filter is None else df.filter(seeds_filter)
    pool_counts = pool.groupBy(label).agg(F.count(F.lit(1)).alias("__m"))
    need = (counts.join(pool_counts, label).filter(F.col("__n") > k)
            .select(label, "__m", (F.lit(top) - F.col("__n")).alias("__need")).filter(F.col("__need") > 0))
    need = cut_lineage(need)
    gen = _samples(need, label).select(label, "__s",
                     (F.floor(_uniform(F.col("__s"), 3 * seed) * F.col("__m")) + 1).cast("long").alias("rank"),
                     (F.floor(_uniform(F.col("__s"), 3 * seed + 1) * k) + 1).cast("int").alias("__j"),
                     _uniform(F.col("__s"), 3 * seed + 2).alias("__lam"))
    ranked = hash_rank(pool.select(label, id_col), id_col, seed, by=(label,)).select(label, id_col, "rank")
    # samples, ranks and neighbours grow with the rows, yet look small (a few deficits spelled out, well compressed ids): sorted
    # joins, as a broadcast of them passes through the driver
    a = gen.join(ranked.hint("merge"), [label, "rank"]).withColumnRenamed(id_col, "__a")
    short = df.join(need.select(label), label, "left_semi")  # classes that are topped up
    nn = knn(short, k, id_col, gx, gy, dims=features, by=[label]).select(
        label, F.col("src").alias("__a"), F.col("rank").cast("int").alias("__j"), F.col("dst").alias("__b"))
    ab = a.join(nn.hint("merge"), [label, "__a", "__j"])
    fa = df.select(F.col(id_col).alias("__a"), *[F.col(c).alias(f"__fa_{c}") for c in features])
    fb = df.select(F.col(id_col).alias("__b"), *[F.col(c).alias(f"__fb_{c}") for c in features])
    syn = ab.join(fa.hint("merge"), "__a").join(fb.hint("merge"), "__b").select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), label,
        *[(F.col(f"__fa_{c}") + F.col("__lam") * (F.col(f"__fb_{c}") - F.col(f"__fa_{c}"))).alias(c)
          for c in features],
        F.lit(True).alias("synthetic"))
    orig = df.select(id_col, label, *features, F.lit(False).alias("synthetic"))
    return orig.unionByName(syn)
