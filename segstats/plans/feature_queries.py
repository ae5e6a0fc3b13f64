"""Feature assembly queries (scan, filters, per-segment sums, joins, density,
imputation, encoding)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segstats.operators import features as ft
from segstats.plans.registry import query
from segstats.session import ensure_checkpoint_dir
from segstats.sources import testdata as td

YEARS = (1999, 2000, 2001)
KEY = td.KEY


def feature_tables(spark, d, years=None):
    return {
        "orders": td.monthly_orders(spark, d, years),
        "items": td.monthly_items(spark, d, years),
        "account": td.static_account(spark, d),
    }


def assemble(spark, d, how="NO_TOTAL", years=YEARS, return_catalogue=False):
    return ft.join_features(td.segments(spark, d), feature_tables(spark, d, years), years, how=how,
                            totals=("orders", "items"), group_fill=("items",),
                            return_catalogue=return_catalogue)


# Shared SQL fragments (DuckDB). Literal 1.0 is DECIMAL in DuckDB, so cast.
_ORDERS_M = """
  SELECT o_custkey AS index_seg, CAST(year(o_orderdate) AS INTEGER) AS YEAR,
         CAST(month(o_orderdate) AS INTEGER) AS MONTH,
         CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE END AS orders_F,
         CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE END AS orders_O,
         CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE END AS orders_P,
         1.0::DOUBLE AS orders_total
  FROM orders"""
_ITEMS_M = """
  SELECT o.o_custkey AS index_seg, CAST(year(o.o_orderdate) AS INTEGER) AS YEAR,
         CAST(month(o.o_orderdate) AS INTEGER) AS MONTH,
         CASE WHEN l_returnflag = 'A' THEN l_quantity END AS qty_A,
         CASE WHEN l_returnflag = 'N' THEN l_quantity END AS qty_N,
         CASE WHEN l_returnflag = 'R' THEN l_quantity END AS qty_R
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


@query("scan_features", sql=f"""
SELECT index_seg, YEAR, MONTH, orders_F, orders_O, orders_P, orders_total FROM ({_ORDERS_M}) t
""")
def scan_features(spark, d):
    """A1: monthly feature table scanned with its key as first column."""
    return td.monthly_orders(spark, d)


@query("filter_year", sql=f"""
SELECT index_seg, orders_F, orders_O, orders_P, orders_total FROM ({_ORDERS_M}) t
WHERE YEAR IN (1999, 2000, 2001)
""")
def filter_year(spark, d):
    """B1: keep YEAR in the window, drop YEAR and MONTH."""
    return ft.filter_year(td.monthly_orders(spark, d, YEARS), YEARS)


@query("filter_total_type", sql=f"""
SELECT index_seg, YEAR, MONTH, orders_F, orders_O, orders_P FROM ({_ORDERS_M}) t
""")
def filter_total_type(spark, d):
    """B2 NO_TOTAL: drop the columns whose name contains 'total'."""
    return ft.filter_total(td.monthly_orders(spark, d), "orders", "NO_TOTAL")


@query("filter_total_sum", sql=f"""
SELECT index_seg, YEAR, MONTH,
       coalesce(qty_A, 0) + coalesce(qty_N, 0) + coalesce(qty_R, 0) AS items_total
FROM ({_ITEMS_M}) t
""")
def filter_total_sum(spark, d):
    """B2 TOTAL on a table without a total column: add the row sum."""
    return ft.filter_total(td.monthly_items(spark, d), "items", "TOTAL")


@query("sum_per_segment", sql=f"""
SELECT index_seg, sum(qty_A) AS qty_A, sum(qty_N) AS qty_N, sum(qty_R) AS qty_R
FROM ({_ITEMS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY index_seg
""")
def sum_per_segment(spark, d):
    """H1: year filter then sum per segment (all-null groups stay null)."""
    return ft.sum_per_segment(ft.filter_year(td.monthly_items(spark, d, YEARS), YEARS))


@query("left_population", sql=f"""
SELECT c.c_custkey AS index_seg, c.c_mktsegment AS name, s.orders_F, s.orders_O, s.orders_P
FROM customer c LEFT JOIN (
  SELECT index_seg, sum(orders_F) AS orders_F, sum(orders_O) AS orders_O, sum(orders_P) AS orders_P
  FROM ({_ORDERS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY index_seg) s
ON c.c_custkey = s.index_seg
""")
def left_population(spark, d):
    """Every segment, nulls where a segment has no rows in the window."""
    t = ft.prepare_table(td.monthly_orders(spark, d, YEARS), "orders", YEARS, "NO_TOTAL")
    return ft.left_population(td.segments(spark, d), t)


@query("semi_segments", sql="""
SELECT c_custkey AS index_seg, c_mktsegment AS name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def semi_segments(spark, d):
    """Restrict the segment list to ids that carry a label."""
    return ft.semi_segments(td.segments(spark, d), td.labels(spark, d))


_JOIN_FEATURES_SQL = f"""
WITH pop AS (SELECT c_custkey AS index_seg, c_mktsegment AS name FROM customer),
o AS (SELECT index_seg, sum(orders_F) AS orders_F, sum(orders_O) AS orders_O, sum(orders_P) AS orders_P
      FROM ({_ORDERS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY index_seg),
i AS (SELECT index_seg, sum(qty_A) AS qty_A, sum(qty_N) AS qty_N, sum(qty_R) AS qty_R
      FROM ({_ITEMS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY index_seg),
w AS (SELECT pop.index_seg, pop.name, o.orders_F, o.orders_O, o.orders_P, i.qty_A, i.qty_N, i.qty_R,
             c.c_acctbal AS acctbal
      FROM pop LEFT JOIN o ON pop.index_seg = o.index_seg
               LEFT JOIN i ON pop.index_seg = i.index_seg
               LEFT JOIN customer c ON pop.index_seg = c.c_custkey),
m AS (SELECT name, avg(qty_A) AS m_A, avg(qty_N) AS m_N, avg(qty_R) AS m_R FROM w GROUP BY name)
SELECT w.index_seg,
       round(coalesce(orders_F, 0), 6) AS orders_F, round(coalesce(orders_O, 0), 6) AS orders_O,
       round(coalesce(orders_P, 0), 6) AS orders_P,
       round(coalesce(qty_A, m_A, 0), 6) AS qty_A, round(coalesce(qty_N, m_N, 0), 6) AS qty_N,
       round(coalesce(qty_R, m_R, 0), 6) AS qty_R,
       round(coalesce(acctbal, 0), 6) AS acctbal
FROM w LEFT JOIN m ON w.name = m.name
"""


@query("join_features", sql=_JOIN_FEATURES_SQL)
def join_features(spark, d):
    """J3 + C1 + C2 + C3: the full feature matrix (flagship query)."""
    return assemble(spark, d)


# ---------------------------------------------------------------------------
# Parameterised SQL for the assembled matrix (years window x TOTAL / NO_TOTAL)
# ---------------------------------------------------------------------------

def _yrs(years) -> str:
    return "(" + ", ".join(str(y) for y in years) + ")"


def matrix_sql(years=YEARS, how="NO_TOTAL", extra_select="") -> str:
    """SQL of ``assemble`` when every column passes the density filter."""
    if how == "NO_TOTAL":
        o_cols, i_cols = ["orders_F", "orders_O", "orders_P"], ["qty_A", "qty_N", "qty_R"]
        o_agg = ", ".join(f"sum({c}) AS {c}" for c in o_cols)
        i_agg = ", ".join(f"sum({c}) AS {c}" for c in i_cols)
    else:
        o_cols, i_cols = ["orders_total"], ["items_total"]
        o_agg = "sum(orders_total) AS orders_total"
        i_agg = "sum(coalesce(qty_A, 0) + coalesce(qty_N, 0) + coalesce(qty_R, 0)) AS items_total"
    sel_o = ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in o_cols)
    sel_i = ", ".join(f"round(coalesce({c}, m_{c}, 0), 6) AS {c}" for c in i_cols)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in i_cols)
    return f"""
WITH pop AS (SELECT c_custkey AS index_seg, c_mktsegment AS name FROM customer),
o AS (SELECT index_seg, {o_agg} FROM ({_ORDERS_M}) t WHERE YEAR IN {_yrs(years)} GROUP BY index_seg),
i AS (SELECT index_seg, {i_agg} FROM ({_ITEMS_M}) t WHERE YEAR IN {_yrs(years)} GROUP BY index_seg),
w AS (SELECT pop.index_seg, pop.name, {", ".join("o." + c for c in o_cols)}, {", ".join("i." + c for c in i_cols)},
             c.c_acctbal AS acctbal
      FROM pop LEFT JOIN o ON pop.index_seg = o.index_seg
               LEFT JOIN i ON pop.index_seg = i.index_seg
               LEFT JOIN customer c ON pop.index_seg = c.c_custkey),
m AS (SELECT name, {means} FROM w GROUP BY name)
SELECT w.index_seg, {sel_o}, {sel_i}, round(coalesce(acctbal, 0), 6) AS acctbal{extra_select}
FROM w LEFT JOIN m ON w.name = m.name
"""


# Window of one year where the orders columns are sparse enough for the
# density filter to matter; threshold is an operator parameter.
SPARSE_YEARS = (2001,)
SPARSE_THRES = 0.25

_SPARSE_WIDE = f"""
WITH pop AS (SELECT c_custkey AS index_seg, c_mktsegment AS name FROM customer),
o AS (SELECT index_seg, sum(orders_F) AS orders_F, sum(orders_O) AS orders_O, sum(orders_P) AS orders_P,
             sum(orders_total) AS orders_total
      FROM ({_ORDERS_M}) t WHERE YEAR IN {_yrs(SPARSE_YEARS)} GROUP BY index_seg),
i AS (SELECT index_seg, sum(qty_A) AS qty_A, sum(qty_N) AS qty_N, sum(qty_R) AS qty_R
      FROM ({_ITEMS_M}) t WHERE YEAR IN {_yrs(SPARSE_YEARS)} GROUP BY index_seg),
w AS (SELECT pop.index_seg, pop.name, o.orders_F, o.orders_O, o.orders_P, o.orders_total,
             i.qty_A, i.qty_N, i.qty_R
      FROM pop LEFT JOIN o ON pop.index_seg = o.index_seg LEFT JOIN i ON pop.index_seg = i.index_seg)"""

_SPARSE_COLS = [("orders", "orders_F"), ("orders", "orders_O"), ("orders", "orders_P"),
                ("orders", "orders_total"), ("items", "qty_A"), ("items", "qty_N"), ("items", "qty_R")]

_SHARES_SQL = _SPARSE_WIDE + """,
s AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS feature_type, '{c}' AS \"column\", {k} AS k, count({c}) / count(*) AS share FROM w"
    for k, (t, c) in enumerate(_SPARSE_COLS)) + ")"


def sparse_wide(spark, d):
    """Population-joined per-segment sums over the sparse window, before filling."""
    tables = {"orders": td.monthly_orders(spark, d, SPARSE_YEARS), "items": td.monthly_items(spark, d, SPARSE_YEARS)}
    prepared = {n: ft.prepare_table(t, n, SPARSE_YEARS, None) for n, t in tables.items()}
    wide = td.segments(spark, d)
    for t in prepared.values():
        wide = wide.join(t, KEY, "left")
    return wide, {n: ft.value_columns(t) for n, t in prepared.items()}


@query("keep_dense_columns", sql=_SHARES_SQL + f"""
SELECT "column", round(share, 6) AS share, share >= {SPARSE_THRES} AS kept FROM s
""")
def keep_dense_columns(spark, d):
    """Non-null share per column over the population and the keep flag."""
    wide, cols = sparse_wide(spark, d)
    return ft.keep_report(wide, [c for cs in cols.values() for c in cs], SPARSE_THRES)


@query("feature_keep_counts", sql=_SHARES_SQL + f"""
SELECT share >= {SPARSE_THRES} AS kept, count(*) AS n FROM s GROUP BY 1
""")
def feature_keep_counts(spark, d):
    """Number of kept and removed columns."""
    wide, cols = sparse_wide(spark, d)
    rep = ft.keep_report(wide, [c for cs in cols.values() for c in cs], SPARSE_THRES)
    return rep.groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("feature_catalogue", sql=_SHARES_SQL + f"""
SELECT feature_type, "column", CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS pos
FROM s WHERE share >= {SPARSE_THRES}
""")
def feature_catalogue(spark, d):
    """A3: catalogue (feature_type, column, pos) of the columns kept by C1."""
    wide, cols = sparse_wide(spark, d)
    kept = set(ft.keep_dense_columns(wide, [c for cs in cols.values() for c in cs], SPARSE_THRES))
    return ft.catalogue_frame(spark, {n: [c for c in cs if c in kept] for n, cs in cols.items()})


@query("feature_counts", sql=_SHARES_SQL + f"""
SELECT feature_type, count(*) AS n_before, count(*) FILTER (WHERE share >= {SPARSE_THRES}) AS n_after
FROM s GROUP BY feature_type
""")
def feature_counts(spark, d):
    """Feature columns per type before and after the density filter."""
    wide, cols = sparse_wide(spark, d)
    rep = ft.keep_report(wide, [c for cs in cols.values() for c in cs], SPARSE_THRES)
    types = spark.createDataFrame([(c, t) for t, cs in cols.items() for c in cs], "column string, feature_type string")
    return (rep.join(F.broadcast(types), "column")
            .groupBy("feature_type")
            .agg(F.count(F.lit(1)).alias("n_before"), F.count(F.when(F.col("kept"), 1)).alias("n_after")))


@query("feature_count_change", sql=_SHARES_SQL + f"""
, a AS (SELECT feature_type, count(*) FILTER (WHERE share >= 0.1) AS n_0 FROM s GROUP BY 1),
  b AS (SELECT feature_type, count(*) FILTER (WHERE share >= {SPARSE_THRES}) AS n_1 FROM s GROUP BY 1)
SELECT a.feature_type, a.n_0 AS n_loose, b.n_1 AS n_strict FROM a JOIN b ON a.feature_type = b.feature_type
""")
def feature_count_change(spark, d):
    """Kept-column counts under two thresholds, inner-joined on type."""
    wide, cols = sparse_wide(spark, d)
    allc = [c for cs in cols.values() for c in cs]
    types = spark.createDataFrame([(c, t) for t, cs in cols.items() for c in cs], "column string, feature_type string")
    shares = ft.non_null_shares(wide, allc).join(F.broadcast(types), "column")
    loose = shares.groupBy("feature_type").agg(F.count(F.when(F.col("share") >= 0.1, 1)).alias("n_loose"))
    strict = shares.groupBy("feature_type").agg(
        F.count(F.when(F.col("share") >= SPARSE_THRES, 1)).alias("n_strict"))
    return loose.join(strict, "feature_type", "inner")


@query("fill_group_mean", sql=_SPARSE_WIDE + """,
m AS (SELECT name, avg(qty_A) AS m_A, avg(qty_N) AS m_N, avg(qty_R) AS m_R FROM w GROUP BY name)
SELECT index_seg, round(coalesce(qty_A, m_A), 6) AS qty_A, round(coalesce(qty_N, m_N), 6) AS qty_N,
       round(coalesce(qty_R, m_R), 6) AS qty_R
FROM w JOIN m ON w.name = m.name
""")
def fill_group_mean(spark, d):
    """Nulls replaced by the mean of the segment type."""
    wide, _ = sparse_wide(spark, d)
    cols = ["qty_A", "qty_N", "qty_R"]
    return ft.fill_group_mean(wide.select(KEY, "name", *cols), "name", cols).select(KEY, *cols)


@query("fill_mean", sql=_SPARSE_WIDE + """
SELECT index_seg,
       round(coalesce(orders_F, (SELECT avg(orders_F) FROM w)), 6) AS orders_F,
       round(coalesce(orders_O, (SELECT avg(orders_O) FROM w)), 6) AS orders_O,
       round(coalesce(orders_P, (SELECT avg(orders_P) FROM w)), 6) AS orders_P
FROM w
""")
def fill_mean(spark, d):
    """C4: nulls replaced by the column mean."""
    wide, _ = sparse_wide(spark, d)
    cols = ["orders_F", "orders_O", "orders_P"]
    return ft.fill_mean(wide.select(KEY, *cols), cols)


@query("features_all_combos", sql="\nUNION ALL BY NAME\n".join(
    f"SELECT * FROM ({matrix_sql(y, h, extra_select=f', {chr(39)}{h}{chr(39)} AS total, {chr(39)}{lbl}{chr(39)} AS years')})"
    for h in ("NO_TOTAL", "TOTAL") for y, lbl in (((1999, 2000, 2001), "~1999"), ((2000, 2001), "~2000"))))
def features_all_combos(spark, d):
    """A5: one matrix per (total mode, years window), stacked with their tags
    (write with ``sinks.write_matrices`` to get one partition per combo)."""
    out = None
    for how in ("NO_TOTAL", "TOTAL"):
        for years, label in (((1999, 2000, 2001), "~1999"), ((2000, 2001), "~2000")):
            m = assemble(spark, d, how=how, years=years).withColumns(
                {"total": F.lit(how), "years": F.lit(label)})
            out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    return out


@query("features_by_family", sql=f"""
SELECT index_seg, orders_F, orders_O, orders_P, acctbal FROM ({matrix_sql()})
""")
def features_by_family(spark, d):
    """The columns of the chosen families in catalogue order."""
    m, cat = assemble(spark, d, return_catalogue=True)
    return ft.select_family(m, ft.catalogue_frame(spark, cat), ["orders", "account"])


@query("sparsity", sql=f"""
WITH x AS ({matrix_sql()})
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS col, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 6) AS pcnt, "
    f"'{t}' AS feature FROM x"
    for t, c in [("orders", "orders_F"), ("orders", "orders_O"), ("orders", "orders_P"), ("items", "qty_A"),
                 ("items", "qty_N"), ("items", "qty_R"), ("account", "acctbal")]))
def sparsity(spark, d):
    """Share of zeros (%) per feature column, tagged with its type."""
    m, cat = assemble(spark, d, return_catalogue=True)
    cols = [c for cs in cat.values() for c in cs]
    types = spark.createDataFrame([(c, t) for t, cs in cat.items() for c in cs], "col string, feature string")
    return ft.zero_shares(m, cols).join(F.broadcast(types), "col")


@query("one_hot", sql="""
SELECT c_custkey AS index_seg, c_acctbal AS acctbal,
       CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS segtype_AUTOMOBILE,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS segtype_BUILDING,
       CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS segtype_FURNITURE,
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS segtype_HOUSEHOLD,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS segtype_MACHINERY
FROM customer
""")
def one_hot(spark, d):
    """One 0/1 column per segment type, named <prefix>_<value>."""
    c = td.table(spark, d, "customer").select(F.col("c_custkey").alias(KEY), F.col("c_acctbal").alias("acctbal"),
                                              "c_mktsegment")
    return ft.one_hot(c, "c_mktsegment", prefix="segtype")


RARE_THRES = 330


@query("rare_category_other", sql=f"""
SELECT p_partkey, CASE WHEN n <= {RARE_THRES} THEN 'OTHER' ELSE p.p_type END AS p_type
FROM part p JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) c ON p.p_type = c.p_type
""")
def rare_category_other(spark, d):
    """Categories seen at most ``threshold`` times collapse to OTHER."""
    p = td.table(spark, d, "part").select("p_partkey", "p_type")
    return ft.rare_category_other(p, "p_type", RARE_THRES)


@query("label_clean", sql=_SPARSE_WIDE + """
SELECT w.index_seg, c.c_nationkey % 11 AS LTS, w.orders_F
FROM w JOIN customer c ON w.index_seg = c.c_custkey
WHERE c.c_nationkey % 11 <> 10 AND w.orders_F IS NOT NULL
""")
def label_clean(spark, d):
    """Ordinal label LTS (10 = invalid) with a feature; invalid and null rows dropped."""
    wide, _ = sparse_wide(spark, d)
    c = td.table(spark, d, "customer").select(F.col("c_custkey").alias(KEY), (F.col("c_nationkey") % 11).alias("LTS"))
    return ft.label_clean(wide.select(KEY, "orders_F").join(c, KEY), "LTS")


@query("encode_columns", sql=f"""
SELECT index_seg, sum(qty_A) AS items_000, sum(qty_N) AS items_001, sum(qty_R) AS items_002
FROM ({_ITEMS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY index_seg
""")
def encode_columns(spark, d):
    """Value columns renamed <name>_000, <name>_001, ..."""
    t = ft.sum_per_segment(ft.filter_year(td.monthly_items(spark, d, YEARS), YEARS))
    return ft.encode_columns(t, "items")


@query("label_features", sql=f"""
SELECT x.*, round(l.csl, 6) AS csl FROM ({matrix_sql()}) x
JOIN (SELECT o_custkey, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS csl
      FROM orders GROUP BY o_custkey) l ON x.index_seg = l.o_custkey
""")
def label_features(spark, d):
    """Inner join of the label (mean rating) with the matrix."""
    return assemble(spark, d).join(td.labels(spark, d), KEY, "inner")


_FAMILIES = {"orders": ["orders_F", "orders_O", "orders_P"], "items": ["qty_A", "qty_N", "qty_R"], "account": ["acctbal"]}
_FAMILY_SETS = [("orders", "items"), ("orders", "account"), ("items", "account")]
_WINDOWS = {"~1999": (1999, 2000, 2001), "~2000": (2000, 2001), "~2001": (2001,)}


@query("feature_matrices", sql="\nUNION ALL BY NAME\n".join(
    f"SELECT index_seg, {', '.join(c for f in fam for c in _FAMILIES[f])}, '{'+'.join(fam)}' AS families, '{lbl}' AS years "
    f"FROM ({matrix_sql(y)})" for fam in _FAMILY_SETS for lbl, y in _WINDOWS.items()))
def feature_matrices(spark, d):
    """Nine matrices (three family lists x three year windows), written
    partitioned by (families, years) and read back as one table."""
    out = None
    for label, years in _WINDOWS.items():
        m, cat = assemble(spark, d, years=years, return_catalogue=True)
        cat = ft.catalogue_frame(spark, cat)
        for fam in _FAMILY_SETS:
            x = ft.select_family(m, cat, list(fam)).withColumns({"families": F.lit("+".join(fam)), "years": F.lit(label)})
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/matrices-{uuid.uuid4().hex}"
    out.write.partitionBy("families", "years").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


_SUPPLY = """
  SELECT o.o_custkey AS index_seg, year(o.o_orderdate) AS YEAR, s.s_acctbal AS supplier_balance,
         p.p_retailprice AS part_price, CAST(p.p_size AS DOUBLE) AS part_size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey"""
_WIDE = {"account": ["acctbal"], "orders": ["orders_F", "orders_O", "orders_P"], "items": ["qty_A", "qty_N", "qty_R"],
         "supply": ["supplier_balance"], "parts": ["part_price", "part_size"], "events": ["event_count", "event_value"],
         "documents": ["doc_count", "doc_chars"]}


def wide_tables(spark, d, years=YEARS):
    """Seven feature tables over the population: monthly ones (orders, items, supply,
    parts) and static ones (account, events, documents; users and documents belong to
    the segment of their id)."""
    o = td.table(spark, d, "orders").filter(td.year_range("o_orderdate", years)).select(
        "o_orderkey", F.col("o_custkey").alias(KEY), F.year("o_orderdate").alias("YEAR"))
    li = td.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s = td.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("supplier_balance"))
    p = td.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("part_price"), F.col("p_size").cast("double").alias("part_size"))
    ev = td.table(spark, d, "events").groupBy(F.col("user_id").alias(KEY)).agg(
        F.count(F.lit(1)).cast("double").alias("event_count"), F.sum("value").alias("event_value"))
    docs = td.table(spark, d, "documents").groupBy(F.col("doc_id").alias(KEY)).agg(
        F.count(F.lit(1)).cast("double").alias("doc_count"), F.sum("n_chars").cast("double").alias("doc_chars"))
    return feature_tables(spark, d, years) | {
        "supply": li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(KEY, "YEAR", "supplier_balance"),
        "parts": li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(KEY, "YEAR", "part_price", "part_size"),
        "events": ev, "documents": docs}


@query("join_features_wide", sql=f"""
WITH pop AS (SELECT c_custkey AS index_seg, c_acctbal AS acctbal FROM customer),
o AS (SELECT index_seg, sum(orders_F) AS orders_F, sum(orders_O) AS orders_O, sum(orders_P) AS orders_P
      FROM ({_ORDERS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY 1),
i AS (SELECT index_seg, sum(qty_A) AS qty_A, sum(qty_N) AS qty_N, sum(qty_R) AS qty_R
      FROM ({_ITEMS_M}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY 1),
s AS (SELECT index_seg, sum(supplier_balance) AS supplier_balance, sum(part_price) AS part_price, sum(part_size) AS part_size
      FROM ({_SUPPLY}) t WHERE YEAR IN (1999, 2000, 2001) GROUP BY 1),
e AS (SELECT user_id AS index_seg, count(*)::DOUBLE AS event_count, sum(value) AS event_value FROM events GROUP BY 1),
x AS (SELECT doc_id AS index_seg, count(*)::DOUBLE AS doc_count, sum(n_chars)::DOUBLE AS doc_chars FROM documents GROUP BY 1)
SELECT pop.index_seg, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for cs in _WIDE.values() for c in cs)}
FROM pop LEFT JOIN o USING (index_seg) LEFT JOIN i USING (index_seg) LEFT JOIN s USING (index_seg)
LEFT JOIN e USING (index_seg) LEFT JOIN x USING (index_seg)
""")
def join_features_wide(spark, d):
    """N-way merge of seven feature tables onto the population (no density filter)."""
    return ft.join_features(td.segments(spark, d), wide_tables(spark, d), YEARS, how="NO_TOTAL", totals=("orders",),
                            drop_na_thres=0.0)
