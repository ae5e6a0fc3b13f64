"""Evaluation queries: scores, confusion matrices, group tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.operators import metrics as mt
from segstats.plans.registry import query
from segstats.sources import testdata as td

KEY = td.KEY
LABELS = [1, 2, 3, 4, 5]


def _bin(x: str) -> str:
    return f"(CASE WHEN {x} < 1 THEN 0 WHEN {x} >= 5 THEN 6 ELSE CAST(floor(5 * ({x} - 1) / (5 - 1)) AS BIGINT) + 1 END)"


_RATINGS = "(SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating FROM orders)"

TP = f"""(SELECT a.index_seg, c.c_mktsegment AS model, {_bin('t')} AS y_true, {_bin('r')} AS y_pred, r AS y_raw
  FROM (SELECT o_custkey AS index_seg, avg(rating) AS t,
               coalesce(avg(CASE WHEN o_orderkey % 2 = 1 THEN rating END), 0.0::DOUBLE) AS r
        FROM {_RATINGS} GROUP BY 1) a JOIN customer c ON a.index_seg = c.c_custkey)"""

TPS = f"""(SELECT o_custkey AS index_seg, seed, {_bin('t')} AS y_true, {_bin('r')} AS y_pred
  FROM (SELECT o_custkey, seed, avg(rating) AS t,
               coalesce(avg(CASE WHEN (o_orderkey + seed) % 3 = 0 THEN rating END), 0.0::DOUBLE) AS r
        FROM {_RATINGS} CROSS JOIN (SELECT unnest(range(0, 10)) AS seed) s GROUP BY 1, 2))"""


def scores_sql(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    gj = (lambda a, b: f"{a}.{by} = {b}.{by} AND ") if by else (lambda a, b: "")
    gc = f"coalesce(s.{by}, q.{by}) AS {by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""

    def r(a, b):
        return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"

    return f"""
WITH T AS {src},
PC AS (SELECT {g}y_true AS t, y_pred AS p, count(*) AS n FROM T GROUP BY ALL),
SUP AS (SELECT {g}t AS label, sum(n) AS support FROM PC GROUP BY ALL),
PRD AS (SELECT {g}p AS label, sum(n) AS n_pred FROM PC GROUP BY ALL),
TPC AS (SELECT {g}t AS label, n AS tp FROM PC WHERE t = p),
PER AS (SELECT {gc}coalesce(s.label, q.label) AS label, coalesce(support, 0) AS support,
               coalesce(n_pred, 0) AS n_pred
        FROM SUP s FULL OUTER JOIN PRD q ON {gj('s', 'q')}s.label = q.label),
P2 AS (SELECT PER.*, coalesce(TPC.tp, 0) AS tp FROM PER LEFT JOIN TPC ON {gj('PER', 'TPC')}PER.label = TPC.label),
P3 AS (SELECT *, {r('tp', 'n_pred')} AS prec, {r('tp', 'support')} AS rec,
              {r('2.0::DOUBLE * tp', 'n_pred + support')} AS f1 FROM P2)
SELECT {g}round({r('sum(tp)', 'sum(support)')}, 6) AS f1_micro, round(avg(f1), 6) AS f1_macro,
       round({r('sum(f1 * support)', 'sum(support)')}, 6) AS f1_weighted,
       round({r('sum(tp)', 'sum(support)')}, 6) AS precision_micro, round(avg(prec), 6) AS precision_macro,
       round({r('sum(prec * support)', 'sum(support)')}, 6) AS precision_weighted,
       round({r('sum(tp)', 'sum(support)')}, 6) AS recall_micro, round(avg(rec), 6) AS recall_macro,
       round({r('sum(rec * support)', 'sum(support)')}, 6) AS recall_weighted
FROM P3 {grp}"""


@query("f1_scores", sql=scores_sql(TP, "model"))
def f1_scores(spark, d):
    """f1 / precision / recall, micro / macro / weighted, per model."""
    return mt.classification_scores(td.truth_pred(spark, d), "y_true", "y_pred", by=["model"])


@query("accuracy_mse", sql=f"""
SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy,
       round(avg(pow(CAST(y_true AS DOUBLE) - y_raw, 2)), 6) AS mse FROM {TP} t
""")
def accuracy_mse(spark, d):
    """accuracy of the binned prediction and MSE of the raw one."""
    return mt.accuracy_mse(td.truth_pred(spark, d), "y_true", "y_pred", "y_raw")


@query("ordinal_scores", sql=f"""
WITH S AS ({scores_sql(TP, "model")}),
A AS (SELECT model, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy,
             round(avg(pow(CAST(y_true AS DOUBLE) - y_raw, 2)), 6) AS mse FROM {TP} t GROUP BY model)
SELECT A.model, accuracy, mse, f1_micro, f1_macro, f1_weighted FROM A JOIN S ON A.model = S.model
""")
def ordinal_scores(spark, d):
    """regression outputs binned with the label binning, then class
    metrics; MSE stays on the raw outputs."""
    tp = td.truth_pred(spark, d)
    tp = mt.ordinal_predictions(tp, "y_raw", 1, 5, out="y_pred")
    acc = mt.accuracy_mse(tp, "y_true", "y_pred", "y_raw", by=["model"])
    sc = mt.classification_scores(tp, "y_true", "y_pred", by=["model"]).select(
        "model", "f1_micro", "f1_macro", "f1_weighted")
    return acc.join(sc, "model")


@query("evaluate_all", sql=f"""
SELECT *, CAST(row_number() OVER (ORDER BY f1_weighted DESC, model) AS INTEGER) AS rank
FROM ({scores_sql(TP, "model")})
""")
def evaluate_all(spark, d):
    """all models scored and ranked by weighted F1 (small table; the
    global ordering runs over one row per model)."""
    from pyspark.sql import Window
    s = mt.classification_scores(td.truth_pred(spark, d), "y_true", "y_pred", by=["model"])
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1_weighted"), "model")).cast("int"))


_CM = f"""WITH T AS {TP},
L AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS y_true),
PC AS (SELECT y_true, y_pred, count(*) AS n FROM T WHERE y_true BETWEEN 1 AND 5 AND y_pred BETWEEN 1 AND 5
       GROUP BY 1, 2),
W AS (SELECT L.y_true, {", ".join(f"coalesce(sum(n) FILTER (WHERE y_pred = {v}), 0) AS p{v}" for v in LABELS)}
      FROM L LEFT JOIN PC ON L.y_true = PC.y_true GROUP BY L.y_true)"""


@query("confusion_matrix", sql=_CM + f"""
SELECT y_true, {", ".join(f"CAST(p{v} AS BIGINT) AS p{v}" for v in LABELS)} FROM W
""")
def confusion_matrix(spark, d):
    """fixed labels 1..5, pairs outside dropped, zero-filled."""
    return mt.confusion_matrix(td.truth_pred(spark, d), "y_true", "y_pred", LABELS)


@query("confusion_row_pct", sql=_CM + f"""
SELECT y_true, {", ".join(
    f"round(CASE WHEN ({' + '.join(f'p{u}' for u in LABELS)}) > 0 THEN p{v} * 100.0::DOUBLE / "
    f"({' + '.join(f'p{u}' for u in LABELS)}) ELSE 0.0 END, 6) AS p{v}" for v in LABELS)} FROM W
""")
def confusion_row_pct(spark, d):
    """row-normalised confusion matrix in percent."""
    return mt.confusion_matrix(td.truth_pred(spark, d), "y_true", "y_pred", LABELS, normalise_rows=True)


_CAVG = f"""WITH T AS {TPS},
G AS (SELECT t, p FROM (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS t)
      CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS p)),
PC AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM T GROUP BY 1, 2),
A AS (SELECT G.t, G.p, coalesce(PC.n, 0) / (SELECT count(DISTINCT seed) FROM T)::DOUBLE AS n_avg
      FROM G LEFT JOIN PC ON G.t = PC.t AND G.p = PC.p)"""


@query("confusion_avg", sql=_CAVG + """
SELECT A.t, A.p, round(n_avg, 6) AS n_avg,
       round(CASE WHEN rs > 0 THEN n_avg * 100.0 / rs ELSE 0.0 END, 6) AS pct
FROM A JOIN (SELECT t, sum(n_avg) AS rs FROM A GROUP BY t) r ON A.t = r.t
""")
def confusion_avg(spark, d):
    """confusion averaged over seeds, with row percentages."""
    long = mt.confusion_average(td.truth_pred_seeds(spark, d), "y_true", "y_pred", LABELS)
    return long.join(mt.row_percent(long), ["t", "p"])


@query("adjacent_miss", sql=_CAVG + """
SELECT round(sum(CASE WHEN p = t - 1 THEN n_avg ELSE 0 END) / sum(CASE WHEN t <> p THEN n_avg END), 6)
         AS more_dangerous,
       round(sum(CASE WHEN p = t + 1 THEN n_avg ELSE 0 END) / sum(CASE WHEN t <> p THEN n_avg END), 6) AS safer,
       round(sum(CASE WHEN p = t - 1 OR p = t + 1 THEN n_avg ELSE 0 END)
             / sum(CASE WHEN t <> p THEN n_avg END), 6) AS both_way
FROM A
""")
def adjacent_miss(spark, d):
    """share of misses one class below / above / either."""
    long = mt.confusion_average(td.truth_pred_seeds(spark, d), "y_true", "y_pred", LABELS)
    return mt.adjacent_miss(long)


@query("ids_by_pair", sql=f"SELECT y_true, y_pred, index_seg FROM {TP} t")
def ids_by_pair(spark, d):
    """segment ids per (true, pred) pair, hits and misses, as a long table."""
    return td.truth_pred(spark, d).select("y_true", "y_pred", KEY)


@query("pair_counts", sql=f"SELECT y_true, y_pred, count(*) AS n FROM {TP} t GROUP BY 1, 2")
def pair_counts(spark, d):
    """Counts per (true, pred) pair."""
    return td.truth_pred(spark, d).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


FEATS = ["acctbal", "n_orders", "avg_price"]

_LONG = f"""(SELECT T.y_true AS grp, f.feature, f.value FROM {TP} T JOIN (
   SELECT c_custkey AS index_seg, c_acctbal AS acctbal, n_orders, avg_price FROM customer c LEFT JOIN (
     SELECT o_custkey, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) o
   ON c.c_custkey = o.o_custkey) X ON T.index_seg = X.index_seg
 CROSS JOIN LATERAL (SELECT unnest(['acctbal', 'n_orders', 'avg_price']) AS feature,
                            unnest([X.acctbal, X.n_orders, X.avg_price]) AS value) f)"""


def long_features(spark, d):
    x = td.segment_features(spark, d)
    t = td.truth_pred(spark, d).select(KEY, F.col("y_true").alias("grp"))
    return mt.to_long(t.join(x, KEY), FEATS, ["grp"])


@query("anova_f", sql=f"""
WITH L AS {_LONG},
G AS (SELECT feature, grp, count(value) AS n_g, avg(value) AS m, var_samp(value) * (count(value) - 1) AS ss
      FROM L GROUP BY 1, 2),
TT AS (SELECT feature, avg(value) AS gm, count(value) AS n_tot FROM L GROUP BY 1),
S AS (SELECT G.feature, sum(n_g * pow(m - gm, 2)) AS ssb, sum(coalesce(ss, 0)) AS ssw, count(*) AS k,
             any_value(n_tot) AS n_tot
      FROM G JOIN TT ON G.feature = TT.feature GROUP BY 1)
SELECT feature, k - 1 AS df_between, n_tot - k AS df_within,
       round((ssb / (k - 1)) / (ssw / (n_tot - k)), 6) AS F FROM S
""")
def anova_f(spark, d):
    """F8: one-way ANOVA F of each feature across the true classes."""
    return mt.anova_f(long_features(spark, d), "grp")


@query("kruskal_h", sql=f"""
WITH L AS (SELECT * FROM {_LONG} WHERE value IS NOT NULL),
R AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM L),
S AS (SELECT feature, sum(rs * rs / n) AS srn, sum(n) AS N, count(*) AS k FROM (
        SELECT feature, grp, sum(r) AS rs, count(*) AS n FROM R GROUP BY 1, 2) GROUP BY 1),
TI AS (SELECT feature, sum(pow(c::DOUBLE, 3) - c) AS tt FROM (
        SELECT feature, value, count(*) AS c FROM L GROUP BY 1, 2) GROUP BY 1)
SELECT S.feature, k - 1 AS df,
       round((12.0 / (N * (N + 1.0)) * srn - 3.0 * (N + 1.0)) / (1.0 - tt / (N::DOUBLE * N * N - N)), 6) AS H
FROM S JOIN TI ON S.feature = TI.feature
""")
def kruskal_h(spark, d):
    """tie-corrected Kruskal-Wallis H of each feature across the classes."""
    return mt.kruskal_h(long_features(spark, d), "grp")


@query("mean_diff", sql=f"""
SELECT feature, round(abs(avg(value) FILTER (WHERE grp = 3) - avg(value) FILTER (WHERE grp = 4)), 6) AS mean_diff
FROM {_LONG} GROUP BY feature
""")
def mean_diff(spark, d):
    """|mean difference| of each feature between classes 3 and 4."""
    return mt.mean_diff(long_features(spark, d), "grp", 3, 4)


@query("group_tests")
def group_tests(spark, d):
    """ANOVA and Kruskal-Wallis statistics with p values and
    significance levels per feature across the true classes, sorted by the
    Kruskal-Wallis p (F and H themselves are oracle-checked by anova_f and
    kruskal_h)."""
    return mt.group_tests(long_features(spark, d), "grp")


@query("group_tests_two")
def group_tests_two(spark, d):
    """the two-group form (classes 3 and 4): adds |mean difference| and
    sorts by it."""
    return mt.group_tests(long_features(spark, d).filter(F.col("grp").isin(3, 4)), "grp")
