"""Labels, splits, folds, sampling, scaling and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.functions.expressions import bounded_round, half_even_round, portable_hash_sql, relevel
from segstats.operators import features as ft
from segstats.operators import labels as lb
from segstats.operators import sampling as sp
from segstats.operators import scaling as sc
from segstats.plans.feature_queries import assemble, matrix_sql
from segstats.plans.registry import query
from segstats.sources import testdata as td

KEY = td.KEY

# The ten split seeds and five label-sampling seeds of the reference.
SPLIT_SEEDS = [0, 100, 972, 5258, 7821, 40918, 57852, 168352, 291592, 789729423]
SAMPLING_SEEDS = [502, 7081, 5128, 5561, 6711]
FRACS = list(range(10, 101, 10))


hsql = portable_hash_sql


_LABELS = """(SELECT o_custkey AS index_seg, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS csl
   FROM orders GROUP BY o_custkey)"""


def _seeds_sql(seeds) -> str:
    return "(SELECT CAST(unnest([" + ", ".join(str(s) for s in seeds) + "]) AS BIGINT) AS seed)"


@query("split_80_20", sql=f"""
WITH h AS (SELECT s.seed, c_custkey AS index_seg, {hsql('c_custkey', 's.seed')} AS h
           FROM customer CROSS JOIN {_seeds_sql(SPLIT_SEEDS)} s),
r AS (SELECT seed, index_seg, row_number() OVER (PARTITION BY seed ORDER BY h, index_seg) AS rk,
             count(*) OVER (PARTITION BY seed) AS n FROM h)
SELECT seed, index_seg, CASE WHEN rk <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM r
""")
def split_80_20(spark, d):
    """Exact 80/20 split for each of the ten seeds (seed, index_seg, part)."""
    seg = td.segments(spark, d).select(KEY)
    return sp.split_seeds(seg, SPLIT_SEEDS)


@query("five_fold", sql=f"""
SELECT index_seg, CAST(ntile(5) OVER (ORDER BY {hsql('c_custkey', '7')}, c_custkey) - 1 AS INTEGER) AS fold
FROM (SELECT c_custkey, c_custkey AS index_seg FROM customer)
""")
def five_fold(spark, d):
    """Shuffled 5-fold assignment, first folds one row larger when n % 5 > 0."""
    return sp.k_fold(td.segments(spark, d).select(KEY), seed=7, k=5)


_TRUTH = """(SELECT o_custkey AS index_seg,
        CASE WHEN a < 1 THEN 0 WHEN a >= 5 THEN 6 ELSE CAST(floor(5 * (a - 1) / (5 - 1)) AS BIGINT) + 1 END AS y_true
   FROM (SELECT o_custkey, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS a FROM orders GROUP BY 1))"""


@query("stratified_folds", sql=f"""
SELECT index_seg, y_true,
       CAST((row_number() OVER (PARTITION BY y_true ORDER BY {hsql('index_seg', '11')}, index_seg) - 1) % 5 AS INTEGER)
         AS fold
FROM {_TRUTH} t
""")
def stratified_folds(spark, d):
    """D3: per-class round-robin folds for stratified cross-validation."""
    t = td.truth_pred(spark, d).select(KEY, "y_true")
    return sp.stratified_folds(t, "y_true", seed=11, k=5)


@query("sample_fraction", sql=f"""
WITH h AS (SELECT s.seed AS sample_seed, l.index_seg, {hsql('l.index_seg', 's.seed')} AS h
           FROM {_LABELS} l CROSS JOIN {_seeds_sql(SAMPLING_SEEDS)} s),
r AS (SELECT sample_seed, index_seg, row_number() OVER (PARTITION BY sample_seed ORDER BY h, index_seg) AS rk,
             count(*) OVER (PARTITION BY sample_seed) AS n FROM h),
f AS (SELECT CAST(unnest([{", ".join(str(x) for x in FRACS)}]) AS INTEGER) AS frac)
SELECT f.frac, r.sample_seed, r.index_seg FROM r CROSS JOIN f
WHERE r.rk <= round_even(r.n * (f.frac / 100.0)::DOUBLE, 0)
""")
def sample_fraction(spark, d):
    """Exact-size label samples, frac 10..100 % x five sampling seeds."""
    labels = td.labels(spark, d).select(KEY)
    x = labels.select(KEY, F.explode(F.array(*[F.lit(s).cast("long") for s in SAMPLING_SEEDS])).alias("sample_seed"))
    r = sp.hash_rank(x, KEY, F.col("sample_seed"), by=("sample_seed",))
    r = r.select(KEY, "sample_seed", "rank", "n", F.explode(F.array(*[F.lit(f) for f in FRACS])).alias("frac"))
    return (r.filter(F.col("rank") <= F.bround(F.col("n") * (F.col("frac") / F.lit(100.0)), 0))
            .select("frac", "sample_seed", KEY))


@query("naive_upsample", sql=f"""
WITH l AS (SELECT index_seg, round_even(csl, 0) AS cls FROM {_LABELS} t),
c AS (SELECT cls, count(*) AS n FROM l GROUP BY cls),
k AS (SELECT cls, CAST(round_even((SELECT max(n) FROM c) / n, 0) AS INTEGER) AS k FROM c)
SELECT l.index_seg, l.cls, CAST(unnest(range(1, k.k + 1)) AS INTEGER) AS copy
FROM l JOIN k ON l.cls = k.cls
""")
def naive_upsample(spark, d):
    """Each class repeated round(max_count / count) times."""
    lab = td.labels(spark, d).select(KEY, half_even_round("csl").alias("cls"))
    return sp.naive_upsample(lab, "cls")


@query("undersample", sql=f"""
WITH l AS (SELECT index_seg, csl, round_even(csl, 0) AS cls FROM {_LABELS} t),
r AS (SELECT index_seg, csl, cls,
             row_number() OVER (PARTITION BY cls ORDER BY {hsql('index_seg', '3')}, index_seg) AS rk FROM l)
SELECT index_seg, round(csl, 6) AS csl, cls FROM r
WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY cls))
""")
def undersample(spark, d):
    """Every rounded class cut to the smallest class size; the label keeps
    its float value."""
    lab = td.labels(spark, d).withColumn("cls", half_even_round("csl"))
    return sp.undersample(lab, "cls", seed=3)


@query("bounded_round", sql=f"""
SELECT index_seg,
       CASE WHEN csl < 1 THEN 0 WHEN csl >= 5 THEN 6 ELSE CAST(floor(5 * (csl - 1) / (5 - 1)) AS BIGINT) + 1 END
         AS y_class
FROM {_LABELS} t
""")
def bounded_round_q(spark, d):
    """L1: equal-width bins over [1, 5]; a label equal to 5 moves to class 6."""
    return td.labels(spark, d).select(KEY, bounded_round("csl", 1, 5).alias("y_class"))


@query("half_even_round", sql=f"SELECT index_seg, round_even(csl, 0) AS y_round FROM {_LABELS} t")
def half_even_round_q(spark, d):
    """L2: round half to even (2.5 -> 2)."""
    return td.labels(spark, d).select(KEY, half_even_round("csl").alias("y_round"))


@query("relevel", sql=f"""
SELECT index_seg, round(1 + (csl - 1) * 2.0::DOUBLE / 4.0::DOUBLE, 6) AS csl_3lvl,
       round(1 + (csl - 1) * 3.0::DOUBLE / 4.0::DOUBLE, 6) AS csl_4lvl
FROM {_LABELS} t
""")
def relevel_q(spark, d):
    """L3: 5-level rating rescaled to 3 and 4 levels."""
    return td.labels(spark, d).select(KEY, relevel("csl", 3).alias("csl_3lvl"), relevel("csl", 4).alias("csl_4lvl"))


# Fixed weighting scheme of the test (status plays the rider level): F 10, O 1, P 100.
SCHEME = [("F", 10.0), ("O", 1.0), ("P", 100.0)]


@query("weighted_rating", sql="""
WITH w AS (SELECT * FROM (VALUES ('F', 10.0::DOUBLE), ('O', 1.0::DOUBLE), ('P', 100.0::DOUBLE)) v(s, weight))
SELECT o_custkey AS index_seg,
       round(sum(coalesce(w.weight, 1.0) * CAST(substr(o_orderpriority, 1, 1) AS INTEGER))
             / sum(coalesce(w.weight, 1.0)), 6) AS csl
FROM orders LEFT JOIN w ON orders.o_orderstatus = w.s GROUP BY o_custkey
""")
def weighted_rating(spark, d):
    """L4: weighted mean rating per segment under a weighting scheme."""
    scheme = spark.createDataFrame(SCHEME, "o_orderstatus string, weight double")
    return lb.weighted_rating(td.order_ratings(spark, d), scheme, "o_orderstatus")


@query("rating_by_subgroup", sql="""
WITH r AS (SELECT o_custkey AS index_seg, o_orderkey, o_orderstatus,
                  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating FROM orders)
SELECT 'o_orderstatus' AS q, o_orderstatus AS a, index_seg, round(avg(rating), 6) AS csl FROM r GROUP BY 1, 2, 3
UNION ALL
SELECT 'parity' AS q, CAST(o_orderkey % 2 AS VARCHAR) AS a, index_seg, round(avg(rating), 6) AS csl
FROM r GROUP BY 1, 2, 3
""")
def rating_by_subgroup(spark, d):
    """One label per respondent subgroup (question, answer)."""
    r = td.order_ratings(spark, d).withColumn("parity", F.col("o_orderkey") % 2)
    return lb.rating_by_subgroup(r, ["o_orderstatus", "parity"])


@query("max_cutoff", sql=f"""
SELECT index_seg, round(least(pow(sum(qty_A) / 1000.0::DOUBLE, 0.75::DOUBLE), 1.0::DOUBLE), 6) AS qty_A,
       round(least(pow(sum(qty_R) / 1000.0::DOUBLE, 0.75::DOUBLE), 1.0::DOUBLE), 6) AS qty_R
FROM (SELECT o.o_custkey AS index_seg, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS qty_A,
             CASE WHEN l_returnflag = 'R' THEN l_quantity END AS qty_R
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) t GROUP BY index_seg
""")
def max_cutoff_q(spark, d):
    """Heavy-tail compression least((x / 1000) ** 0.75, 1)."""
    t = ft.sum_per_segment(td.monthly_items(spark, d).select(KEY, "qty_A", "qty_R"))
    return t.select(KEY, sc.max_cutoff("qty_A").alias("qty_A"), sc.max_cutoff("qty_R").alias("qty_R"))


_SPLIT0 = f"""(SELECT index_seg, CASE WHEN rk <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part
   FROM (SELECT c_custkey AS index_seg, row_number() OVER (ORDER BY {hsql('c_custkey', '0')}, c_custkey) AS rk,
                count(*) OVER () AS n FROM customer))"""

_MM_COLS = ["orders_F", "orders_O", "orders_P", "qty_A", "qty_N", "qty_R", "acctbal"]


def split0(spark, d):
    return sp.split_80_20(td.segments(spark, d).select(KEY), SPLIT_SEEDS[0])


@query("train_test_rows", sql=f"""
SELECT s.part, x.* FROM ({matrix_sql()}) x JOIN {_SPLIT0} s ON x.index_seg = s.index_seg
""")
def train_test_rows(spark, d):
    """Feature rows looked up by the split's id lists (inner join)."""
    return assemble(spark, d).join(split0(spark, d), KEY, "inner")


@query("lookup_upsampled", sql=f"""
WITH l AS (SELECT index_seg, round_even(csl, 0) AS cls FROM {_LABELS} t),
c AS (SELECT cls, count(*) AS n FROM l GROUP BY cls),
k AS (SELECT cls, CAST(round_even((SELECT max(n) FROM c) / n, 0) AS INTEGER) AS k FROM c),
u AS (SELECT l.index_seg, l.cls, unnest(range(1, k.k + 1)) AS copy FROM l JOIN k ON l.cls = k.cls)
SELECT CAST(row_number() OVER (ORDER BY u.cls, u.index_seg, u.copy) - 1 AS BIGINT) AS position, u.cls, x.*
FROM u JOIN ({matrix_sql()}) x ON u.index_seg = x.index_seg
""")
def lookup_upsampled(spark, d):
    """Feature rows looked up by an id list that repeats ids, in list order."""
    lab = td.labels(spark, d).select(KEY, half_even_round("csl").alias("cls"))
    ids = sp.naive_upsample(lab, "cls").join(td.segments(spark, d).select(KEY), KEY, "left_semi")
    return sp.lookup(assemble(spark, d), ids, ["cls", KEY, "copy"]).drop("copy")


@query("minmax_scale", sql=f"""
WITH x AS (SELECT s.part, m.* FROM ({matrix_sql()}) m JOIN {_SPLIT0} s ON m.index_seg = s.index_seg),
st AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _MM_COLS)} FROM x WHERE part = 'train')
SELECT x.index_seg, x.part, {", ".join(
    f"round(CASE WHEN hi_{c} = lo_{c} THEN x.{c} - lo_{c} ELSE (x.{c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}"
    for c in _MM_COLS)}
FROM x CROSS JOIN st
""")
def minmax_scale(spark, d):
    """Min-max fitted on the train rows, applied to train and test."""
    x = assemble(spark, d).join(split0(spark, d), KEY, "inner")
    fitted = sc.fit_minmax(x.filter(F.col("part") == "train"), _MM_COLS)
    return sc.apply_minmax(x, fitted)


@query("variance_select", sql=f"""
WITH x AS ({matrix_sql()})
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_pop({c}), 6) AS var, var_pop({c}) > 1.0 AS kept FROM x"
    for c in _MM_COLS))
def variance_select(spark, d):
    """Population variance per column and the keep flag (var > 1)."""
    m = assemble(spark, d)
    return sc.variances(m, _MM_COLS).withColumn("kept", F.col("var") > F.lit(1.0))


@query("anti_fold", sql=f"""
SELECT l.index_seg, round(l.csl, 6) AS csl FROM {_LABELS} l
WHERE l.index_seg NOT IN (
  SELECT index_seg FROM (SELECT index_seg,
    ntile(5) OVER (ORDER BY {hsql('index_seg', '7')}, index_seg) AS f FROM {_LABELS} t) WHERE f = 1)
""")
def anti_fold(spark, d):
    """Rows outside fold 0 (left anti join against the fold's ids)."""
    lab = td.labels(spark, d)
    fold0 = sp.k_fold(lab.select(KEY), seed=7, k=5).filter(F.col("fold") == 0)
    return lab.join(fold0, KEY, "left_anti")


@query("reduce_split", sql=f"""
WITH r AS (SELECT index_seg, csl, row_number() OVER (ORDER BY {hsql('index_seg', '502')}, index_seg) AS rk,
                  count(*) OVER () AS n FROM {_LABELS} l),
s AS (SELECT index_seg, csl FROM r WHERE rk <= round_even(n * 0.5::DOUBLE, 0)),
t AS (SELECT index_seg, csl, row_number() OVER (ORDER BY {hsql('index_seg', '0')}, index_seg) AS rk,
             count(*) OVER () AS n FROM s)
SELECT index_seg, round(csl, 6) AS csl, CASE WHEN rk <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part
FROM t
""")
def reduce_split(spark, d):
    """A 50 % label sample, then the normal 80/20 split of what remains."""
    s = sp.sample_exact(td.labels(spark, d), 0.5, SAMPLING_SEEDS[0])
    return sp.split_80_20(s, SPLIT_SEEDS[0])


@query("reconstruct_pairs", sql=f"""
WITH o AS (SELECT o_custkey AS index_seg, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
                  row_number() OVER (ORDER BY {hsql('o_orderkey', '502')}, o_orderkey) AS rk,
                  count(*) OVER () AS n FROM orders),
tr AS (SELECT index_seg, avg(rating) AS y_train FROM o WHERE rk <= round_even(n * 0.3::DOUBLE, 0) GROUP BY 1),
te AS (SELECT index_seg, avg(rating) AS y_test FROM o GROUP BY 1)
SELECT tr.index_seg, round(y_train, 6) AS y_train, round(y_test, 6) AS y_test
FROM tr JOIN te ON tr.index_seg = te.index_seg
""")
def reconstruct_pairs(spark, d):
    """Train label from a 30 % sample of individual ratings, test label
    from all ratings, for the same segments."""
    r = td.order_ratings(spark, d)
    sampled = sp.sample_exact(r, 0.3, SAMPLING_SEEDS[0], id_col="o_orderkey")
    tr = sampled.groupBy(KEY).agg(F.avg("rating").alias("y_train"))
    te = r.groupBy(KEY).agg(F.avg("rating").alias("y_test"))
    return tr.join(te, KEY, "inner")


@query("label_mode", sql=f"""
SELECT CAST(arg_min(cls, (-n, cls)) AS DOUBLE) AS mode FROM (
  SELECT round_even(csl, 0) AS cls, count(*) AS n FROM {_LABELS} t GROUP BY 1)
""")
def label_mode(spark, d):
    """Mode of the rounded labels, ties to the smallest value."""
    return lb.label_mode(td.labels(spark, d).select(half_even_round("csl").alias("cls")), "cls")


@query("majority_baseline", sql=f"""
WITH m AS (SELECT arg_min(cls, (-n, cls)) AS mode FROM (
  SELECT round_even(csl, 0) AS cls, count(*) AS n FROM {_LABELS} t GROUP BY 1))
SELECT l.index_seg, CAST(round_even(l.csl, 0) AS DOUBLE) AS y_true, m.mode AS y_pred FROM {_LABELS} l CROSS JOIN m
""")
def majority_baseline(spark, d):
    """The majority class predicted for every segment."""
    lab = td.labels(spark, d).select(KEY, half_even_round("csl").alias("y_true"))
    mode = lb.label_mode(lab, "y_true").first()["mode"]
    return lab.withColumn("y_pred", F.lit(mode).cast("double"))


@query("n_classes", sql=f"SELECT count(DISTINCT round_even(csl, 0)) AS n_classes FROM {_LABELS} t")
def n_classes(spark, d):
    """Number of distinct rounded classes."""
    return td.labels(spark, d).agg(F.countDistinct(half_even_round("csl")).alias("n_classes"))


@query("class_distribution", sql=f"""
SELECT round_even(csl, 0) AS cls, count(*) AS n FROM {_LABELS} t GROUP BY 1
""")
def class_distribution(spark, d):
    """Value counts of the rounded label."""
    return td.labels(spark, d).groupBy(half_even_round("csl").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


_MI_COLS = ["orders_F", "orders_O", "orders_P", "qty_A", "qty_N", "qty_R", "acctbal"]


def _mi_sql() -> str:
    x = f"""(SELECT m.*, CASE WHEN l.csl < 1 THEN 0 WHEN l.csl >= 5 THEN 6
                 ELSE CAST(floor(5 * (l.csl - 1) / (5 - 1)) AS BIGINT) + 1 END AS y_cls
          FROM ({matrix_sql()}) m JOIN {_LABELS} l ON m.index_seg = l.index_seg)"""
    parts = []
    for c in _MI_COLS:
        lo, hi = f"(SELECT min({c}) FROM X)", f"(SELECT max({c}) FROM X)"
        b = (f"CASE WHEN {hi} = {lo} THEN 1 WHEN {c} >= {hi} THEN 10 "
             f"ELSE CAST(floor(10 * ({c} - {lo}) / ({hi} - {lo})) AS BIGINT) + 1 END")
        parts.append(f"SELECT '{c}' AS feature, {b} AS bx, y_cls AS y FROM X")
    return f"""
WITH X AS {x},
L AS ({" UNION ALL ".join(parts)}),
NXY AS (SELECT feature, bx, y, count(*) AS nxy FROM L GROUP BY 1, 2, 3),
NX AS (SELECT feature, bx, sum(nxy) AS nx FROM NXY GROUP BY 1, 2),
NY AS (SELECT feature, y, sum(nxy) AS ny FROM NXY GROUP BY 1, 2),
N AS (SELECT feature, sum(nxy) AS n FROM NXY GROUP BY 1)
SELECT NXY.feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi
FROM NXY JOIN NX ON NXY.feature = NX.feature AND NXY.bx = NX.bx
         JOIN NY ON NXY.feature = NY.feature AND NXY.y = NY.y
         JOIN N ON NXY.feature = N.feature
GROUP BY NXY.feature"""


@query("mrmr_relevance", sql=_mi_sql())
def mrmr_relevance(spark, d):
    """C8 relevance step: mutual information of each binned feature with the
    class (10 equal-width bins)."""
    x = assemble(spark, d).join(td.labels(spark, d), KEY).withColumn("y_cls", bounded_round("csl", 1, 5))
    return sc.mutual_information(sc.equal_width_bins(x.select(*_MI_COLS, "y_cls"), _MI_COLS, 10), _MI_COLS, "y_cls")
