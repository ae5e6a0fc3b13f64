"""Spatial queries on the point table (embeddings: x = dim 0, y = dim 1).

Oracles are brute-force all-pairs SQL; the Spark side uses the grid-cell
equi-join. Bands 0.02 / 0.05 / 0.1 play the reference's metre bands.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.operators.spatial import gstar as gs
from segstats.operators.spatial import lag
from segstats.operators.spatial import moran as mo
from segstats.operators.spatial import weights as wt
from segstats.operators.spatial.neighbours import neighbour_sums, per_id
from segstats.plans.registry import query
from segstats.sources import testdata as td

BAND = 0.05
BANDS = [0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1]
FEATS = ["f0", "f1", "f2", "f3"]
K = 3

# ---------------------------------------------------------------------------
# SQL builders
# ---------------------------------------------------------------------------

PTS = """(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
        CAST(label AS DOUBLE) AS value, CAST(embedding[3] AS DOUBLE) AS f0, CAST(embedding[4] AS DOUBLE) AS f1,
        CAST(embedding[5] AS DOUBLE) AS f2, CAST(embedding[6] AS DOUBLE) AS f3 FROM embeddings)"""

_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

# Same Chebyshev coefficients as segstats.functions.expressions.erfc.
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _lit(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def erfc_sql(x: str) -> str:
    """SQL twin of ``erfc`` for x >= 0 (the only case the queries need)."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * ({x})))"
    poly = _lit(_ERFC[-1])
    for a in reversed(_ERFC[:-1]):
        poly = f"({_lit(a)} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def sf_sql(z_abs: str) -> str:
    """SQL twin of ``normal_sf`` for a non-negative argument."""
    return f"(0.5::DOUBLE * {erfc_sql(f'({z_abs}) / {_lit(2.0 ** 0.5)}')})"


def edges_sql(bands, weight="binary") -> str:
    """All ordered pairs within each band (brute force), with param and w."""
    bl = ", ".join(_lit(b) for b in bands)
    w = "1.0::DOUBLE" if weight == "binary" else f"CASE WHEN sqrt({_D2}) > 0 THEN pow(sqrt({_D2}), -1.0::DOUBLE) END"
    return f"""(SELECT p.param, a.id AS src, b.id AS dst, sqrt({_D2}) AS d, {w} AS w
   FROM {PTS} a JOIN {PTS} b ON a.id <> b.id
   JOIN (SELECT unnest([{bl}]) AS param) p ON {_D2} <= p.param * p.param)"""


def knn_edges_sql(ks) -> str:
    """Brute-force KNN edges for every k in ``ks`` (ties by id), param = k."""
    kl = ", ".join(str(int(k)) for k in ks)
    return f"""(SELECT CAST(p.k AS DOUBLE) AS param, r.src, r.dst, r.d, 1.0::DOUBLE AS w FROM (
     SELECT a.id AS src, b.id AS dst, sqrt({_D2}) AS d,
            row_number() OVER (PARTITION BY a.id ORDER BY sqrt({_D2}), b.id) AS rk
     FROM {PTS} a JOIN {PTS} b ON a.id <> b.id) r
   JOIN (SELECT unnest([{kl}]) AS k) p ON r.rk <= p.k)"""


def moran_sql(bands, cols, weight="binary", variance="textbook", edges: str | None = None) -> str:
    n_expr = "(SELECT count(*) FROM P)"
    parts = []
    for c in cols:
        parts.append(f"""SELECT g.param, '{c}' AS "column",
  (SELECT count(*) FROM P)::DOUBLE AS n,
  (SELECT sum(pow(z, 2)) FROM (SELECT {c} - (SELECT avg({c}) FROM P) AS z FROM P)) AS m2,
  (SELECT sum(pow(z, 4)) FROM (SELECT {c} - (SELECT avg({c}) FROM P) AS z FROM P)) AS m4,
  (SELECT sum(W.w * ({c}_s - mu) * ({c}_d - mu)) FROM (
      SELECT W.w, s.{c} AS {c}_s, d.{c} AS {c}_d, (SELECT avg({c}) FROM P) AS mu
      FROM W JOIN P s ON W.src = s.id JOIN P d ON W.dst = d.id WHERE W.param = g.param) W) AS num,
  g.s0, g.s1, g.s2, g.pcnt_islands
FROM G g""")
    cols_sql = "\nUNION ALL\n".join(parts)
    ei = "(-1.0::DOUBLE / (n - 1.0))"
    vn = f"((n * n * s1 - n * s2 + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - {ei} * {ei})"
    a = "(n * ((n * n - 3.0 * n + 3.0) * s1 - n * s2 + 3.0 * s0 * s0))"
    if variance == "compat":
        k = "(m2 * m2 / m4)"
        vr = f"(({a} - {k} * ((n * n - n) * s1 - 2.0 * n * s2 + 6.0 * s0 * s0)) / (pow(n - 1.0, 3) * s0 * s0))"
    else:
        k = "(n * m4 / (m2 * m2))"
        vr = (f"(({a} - {k} * ((n * n - n) * s1 - 2.0 * n * s2 + 6.0 * s0 * s0)) "
              f"/ ((n - 1.0) * (n - 2.0) * (n - 3.0) * s0 * s0) - {ei} * {ei})")
    i_val = "(CASE WHEN s0 > 0 THEN n / s0 * coalesce(num, 0) / m2 END)"
    return f"""
WITH P AS {PTS},
E AS {edges if edges is not None else edges_sql(bands, weight)},
RS AS (SELECT param, src, sum(w) AS rs FROM E WHERE w IS NOT NULL GROUP BY 1, 2),
W AS (SELECT E.param, E.src, E.dst, E.w / RS.rs AS w FROM E JOIN RS ON E.param = RS.param AND E.src = RS.src
      WHERE E.w IS NOT NULL),
S1 AS (SELECT coalesce(a.param, b.param) AS param,
              0.5 * sum(pow(coalesce(a.w, 0) + coalesce(b.w, 0), 2)) AS s1
       FROM W a FULL OUTER JOIN W b ON a.param = b.param AND a.src = b.dst AND a.dst = b.src GROUP BY 1),
RR AS (SELECT param, src AS node, sum(w) AS r FROM W GROUP BY 1, 2),
CC AS (SELECT param, dst AS node, sum(w) AS c FROM W GROUP BY 1, 2),
S2 AS (SELECT coalesce(RR.param, CC.param) AS param,
              sum(pow(coalesce(r, 0) + coalesce(c, 0), 2)) AS s2, count(r) AS n_linked
       FROM RR FULL OUTER JOIN CC ON RR.param = CC.param AND RR.node = CC.node GROUP BY 1),
G AS (SELECT S1.param, (SELECT sum(w) FROM W WHERE W.param = S1.param) AS s0, s1, s2,
             ({n_expr} - n_linked) / {n_expr}::DOUBLE AS pcnt_islands
      FROM S1 JOIN S2 ON S1.param = S2.param),
R AS ({cols_sql}),
I AS (SELECT param, "column", {i_val} AS I, {ei} AS EI, {vn} AS vn, {vr} AS vr, pcnt_islands FROM R)
SELECT param, "column", round(I, 6) AS I, round(EI, 6) AS EI,
       round((I - EI) / sqrt(vn), 6) AS z_norm,
       round(2.0::DOUBLE * {sf_sql('abs((I - EI) / sqrt(vn))')}, 6) AS p_norm,
       round((I - EI) / sqrt(vr), 6) AS z_rand,
       round(2.0::DOUBLE * {sf_sql('abs((I - EI) / sqrt(vr))')}, 6) AS p_rand,
       round(pcnt_islands, 6) AS pcnt_islands
FROM I"""


def gstar_sql(bands) -> str:
    return f"""
WITH P AS {PTS},
E AS {edges_sql(bands)},
ST AS (SELECT count(*)::DOUBLE AS n, avg(value) AS m, stddev_pop(value) AS sd FROM P),
NB AS (SELECT E.param, E.src, sum(P.value) AS sv, count(*) AS cnt FROM E JOIN P ON E.dst = P.id GROUP BY 1, 2),
N AS (SELECT b.param, P.id, P.value, coalesce(NB.sv, 0) + P.value AS sumv, coalesce(NB.cnt, 0)::DOUBLE + 1.0 AS W
      FROM P CROSS JOIN (SELECT unnest([{", ".join(_lit(b) for b in bands)}]) AS param) b
      LEFT JOIN NB ON NB.param = b.param AND NB.src = P.id),
Z AS (SELECT param, id, value, (sumv - W * ST.m) / (ST.sd * sqrt((ST.n * W - W * W) / (ST.n - 1.0))) AS Zs
      FROM N CROSS JOIN ST)
SELECT param, id, value, Zs, {sf_sql('abs(Zs)')} AS p_norm FROM Z"""


def _spot_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN p_norm < 0.05 AND Zs > 0 THEN 'hot' WHEN p_norm < 0.05 AND Zs < 0 THEN 'cold'
       ELSE 'None' END AS spot,
  CAST(CASE WHEN p_norm < 0.001 THEN 2 WHEN p_norm < 0.01 THEN 1 WHEN p_norm < 0.05 THEN 0 ELSE -1 END AS INTEGER)
    AS sig_lvl FROM ({src})"""


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def pts(spark, d):
    return td.point_features(spark, d, n=4)


@query("distance_band", sql=f"""
SELECT src, dst, round(d, 6) AS d FROM {edges_sql([BAND])}
""")
def distance_band(spark, d):
    """Directed edges within the band (grid-cell equi-join)."""
    return wt.distance_band(pts(spark, d), BAND)


@query("distance_band_inv", sql=f"""
SELECT src, dst, round(w, 6) AS w FROM {edges_sql([BAND], 'inverse')}
""")
def distance_band_inv(spark, d):
    """The same edges weighted 1 / d."""
    return wt.inverse_distance_weights(wt.distance_band(pts(spark, d), BAND)).select("src", "dst", "w")


@query("islands", sql=f"""
WITH P AS {PTS}, E AS {edges_sql(BANDS)},
B AS (SELECT unnest([{", ".join(_lit(b) for b in BANDS)}]) AS param)
SELECT B.param, count(*) AS n_islands, round(count(*) / (SELECT count(*) FROM P)::DOUBLE, 6) AS pcnt_islands
FROM B CROSS JOIN P WHERE NOT EXISTS (SELECT 1 FROM E WHERE E.param = B.param AND E.src = P.id)
GROUP BY B.param
""")
def islands_q(spark, d):
    """Number and share of islands per band."""
    p = pts(spark, d)
    n = p.count()
    e = neighbour_sums(p, BANDS, {})
    nodes = p.select("id", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("param"))
    isl = nodes.join(e.select("param", "id").distinct(), ["param", "id"], "left_anti")
    return isl.groupBy("param").agg(F.count(F.lit(1)).alias("n_islands"),
                                    (F.count(F.lit(1)) / F.lit(float(n))).alias("pcnt_islands"))


@query("knn_graph", sql=f"""
WITH P AS {PTS},
C AS (SELECT a.id AS src, b.id AS dst, sqrt({_D2}) AS d FROM P a JOIN P b ON a.id <> b.id),
R AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM C)
SELECT src, dst, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM R WHERE rank <= {K}
""")
def knn_graph(spark, d):
    """Exact k nearest neighbours (k = 3), ties by id."""
    return wt.knn(pts(spark, d), K).withColumn("rank", F.col("rank").cast("int"))


def _band_moran(spark, d, bands, cols, weight="binary", variance="textbook"):
    return mo.band_moran(pts(spark, d), bands, cols, inverse=weight == "inverse", variance=variance)


@query("moran_i", sql=moran_sql([BAND], ["value"]))
def moran_i(spark, d):
    """Moran's I of the value at one band (binary, row-standardised)."""
    return _band_moran(spark, d, [BAND], ["value"])


@query("moran_inference", sql=moran_sql([BAND], ["value", "f0"], weight="inverse", variance="compat"))
def moran_inference(spark, d):
    """G5 + G9: inverse-distance weights, randomisation variance in the
    reference-compatible form."""
    return _band_moran(spark, d, [BAND], ["value", "f0"], weight="inverse", variance="compat")


@query("moran_grid", sql=moran_sql(BANDS, ["value"] + FEATS))
def moran_grid(spark, d):
    """Every column x every band in one job."""
    return _band_moran(spark, d, BANDS, ["value"] + FEATS)


@query("moran_best_param", sql=f"""
WITH M AS ({moran_sql(BANDS, ["value"] + FEATS)})
SELECT "column", arg_max(param, (I, -param)) AS param, max(I) AS I,
       arg_max(p_norm, (I, -param)) AS p_norm, arg_max(z_norm, (I, -param)) AS z_norm,
       CASE WHEN "column" = 'value' THEN 'label' ELSE 'embedding' END AS ftr_type
FROM M WHERE p_norm < 0.05 GROUP BY "column"
""")
def moran_best_param(spark, d):
    """Per column the band with the largest I among p_norm < 0.05, tagged
    with the feature type."""
    m = _band_moran(spark, d, BANDS, ["value"] + FEATS)
    best = mo.best_param(m).select("column", "param", "I", "p_norm", "z_norm")
    types = spark.createDataFrame([("value", "label")] + [(c, "embedding") for c in FEATS],
                                  "column string, ftr_type string")
    return best.join(F.broadcast(types), "column", "left")


@query("moran_sig_counts", sql=f"""
WITH M AS ({moran_sql(BANDS, ["value"] + FEATS)})
SELECT param, count(*) FILTER (WHERE p_norm < 0.05) AS n_sig_05, count(*) FILTER (WHERE p_norm < 0.001) AS n_sig_001
FROM M GROUP BY param
""")
def moran_sig_counts(spark, d):
    """Number of significant columns per band."""
    return mo.significant_counts(_band_moran(spark, d, BANDS, ["value"] + FEATS))


@query("moran_select", sql=f"""
WITH M AS ({moran_sql(BANDS, ["value"] + FEATS)})
SELECT "column", I FROM M WHERE param = {_lit(BANDS[0])} AND p_rand < 0.05 AND abs(I) >= 0.01
""")
def moran_select(spark, d):
    """Columns with p_rand < 0.05 and |I| >= threshold at the chosen band."""
    return mo.select_columns(_band_moran(spark, d, BANDS, ["value"] + FEATS), BANDS[0], 0.01)


_NB_SQL = f"""WITH P AS {PTS}, E AS {edges_sql([BAND])},
NB AS (SELECT E.src, {", ".join(f"avg(P.{c}) AS {c}_neighbor" for c in FEATS)}
       FROM E JOIN P ON E.dst = P.id GROUP BY E.src)"""


@query("neighbour_mean", sql=_NB_SQL + f"""
SELECT P.id, {", ".join(f"round(coalesce(NB.{c}_neighbor, 0), 6) AS {c}_neighbor" for c in FEATS)}
FROM P LEFT JOIN NB ON P.id = NB.src
""")
def neighbour_mean(spark, d):
    """Neighbour average per feature, islands filled with 0."""
    p = pts(spark, d)
    return lag.band_neighbour_mean(p, BAND, FEATS)


@query("join_neighbour_features", sql=_NB_SQL + f"""
SELECT P.id, P.value, {", ".join(f"P.{c}" for c in FEATS)},
       {", ".join(f"round(coalesce(NB.{c}_neighbor, 0), 6) AS {c}_neighbor" for c in FEATS)}
FROM P LEFT JOIN NB ON P.id = NB.src
""")
def join_neighbour_features(spark, d):
    """Self + neighbour matrix (left join on id)."""
    p = pts(spark, d)
    nb = lag.band_neighbour_mean(p, BAND, FEATS)
    return lag.spatial_matrix(p.select("id", "value", *FEATS), nb)


def _gstar(spark, d, bands):
    return gs.band_gstar(pts(spark, d), bands)


@query("local_gstar", sql=f"""
SELECT id, value, round(Zs, 6) AS Zs, round(p_norm, 6) AS p_norm, spot, sig_lvl,
       CASE WHEN spot = 'hot' THEN ['#fddbc7', '#ef8a62', '#b2182b'][greatest(sig_lvl, 0) + 1]
            WHEN spot = 'cold' THEN ['#d1e5f0', '#67a9cf', '#2166ac'][greatest(sig_lvl, 0) + 1]
            ELSE '#f7f7f7' END AS color
FROM ({_spot_sql(gstar_sql([BAND]))})
""")
def local_gstar(spark, d):
    """Z, one-sided p, hot / cold label, level and colour."""
    g = gs.classify_spots(_gstar(spark, d, [BAND]))
    return gs.spot_colour(g).drop("param")


@query("spot_counts", sql=f"""
SELECT param, count(*) FILTER (WHERE p_norm < 0.05) AS total,
       count(*) FILTER (WHERE p_norm < 0.05 AND Zs > 0) AS hot,
       count(*) FILTER (WHERE p_norm < 0.05 AND Zs < 0) AS cold
FROM ({gstar_sql(BANDS)}) GROUP BY param
""")
def spot_counts(spark, d):
    """Hot / cold / total significant spots per band."""
    return gs.spot_counts(_gstar(spark, d, BANDS))


@query("sig_level", sql=f"""
SELECT sig_lvl, count(*) AS n FROM ({_spot_sql(gstar_sql([BAND]))}) GROUP BY sig_lvl
""")
def sig_level_q(spark, d):
    """Nodes per significance level."""
    g = gs.classify_spots(_gstar(spark, d, [BAND]))
    return g.groupBy("sig_lvl").agg(F.count(F.lit(1)).alias("n"))


@query("hot_cold", sql=f"""
SELECT spot, count(*) AS n FROM ({_spot_sql(gstar_sql([BAND]))}) GROUP BY spot
""")
def hot_cold(spark, d):
    """Nodes per spot label."""
    g = gs.classify_spots(_gstar(spark, d, [BAND]))
    return g.groupBy("spot").agg(F.count(F.lit(1)).alias("n"))


@query("gradient_colour", sql=f"""
WITH P AS {PTS}, E AS {edges_sql([BAND])},
C AS (SELECT P.id, count(E.dst) AS n_nb FROM P LEFT JOIN E ON E.src = P.id GROUP BY P.id),
L AS (SELECT id, n_nb, ln(n_nb + 1.0) AS v FROM C)
SELECT id, n_nb, printf('#%02x%02x%02x',
  CAST(trunc(251.0 + (-3.0) * (v / (SELECT max(v) FROM L))) AS INTEGER),
  CAST(trunc(248.0 + (-143.0) * (v / (SELECT max(v) FROM L))) AS INTEGER),
  CAST(trunc(179.0 + (-72.0) * (v / (SELECT max(v) FROM L))) AS INTEGER)) AS color
FROM L
""")
def gradient_colour(spark, d):
    """Log-count gradient colour of each node's neighbour count."""
    p = pts(spark, d)
    deg = (p.select("id").join(per_id(neighbour_sums(p, [BAND], {})).select("id", F.col("neighbours").alias("n_nb")), "id", "left")
           .na.fill(0, subset=["n_nb"]))
    return gs.gradient_colour(deg, "n_nb")


@query("moran_knn", sql=moran_sql(None, ["value", "f0"], edges=knn_edges_sql(list(range(1, 11)))))
def moran_knn(spark, d):
    """G3 + G11: Moran's I for k = 1..10 nearest neighbours, all k from one
    exact search (asymmetric weights: the pair / reverse-pair path)."""
    p = td.point_features(spark, d, 4)
    e = wt.knn_family(p, list(range(1, 11))).withColumn("param", F.col("param").cast("double"))
    return mo.moran(p, e, ["value", "f0"])


@query("moran_permutation")
def moran_permutation(spark, d):
    """Permutation inference (999 permutations) for the value's
    Moran's I at the band; pseudo p is bounded below by 1 / (perms + 1)."""
    return mo.band_permutations(pts(spark, d), BAND, "value", perms=999)


@query("neighbour_only_matrix", sql=f"""
WITH P AS {PTS}, E AS {edges_sql([BAND])}
SELECT P.id, {", ".join(f"round(coalesce(avg(N.{c}), 0), 6) AS {c}_neighbor" for c in FEATS)}
FROM P LEFT JOIN E ON E.src = P.id LEFT JOIN P N ON N.id = E.dst GROUP BY P.id
""")
def neighbour_only_matrix(spark, d):
    """The matrix of the neighbours' means alone (islands 0)."""
    p = td.point_features(spark, d, 4)
    nb = lag.band_neighbour_mean(p, BAND, FEATS)
    return lag.spatial_matrix(p, nb, neighbour_only=True)
