"""Report queries over the run-result table (customer x seed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.functions.expressions import fixed_decimals, portable_hash_sql
from segstats.operators import reports as rp
from segstats.plans.registry import query
from segstats.sources import testdata as td

SETS = [f"set{i}" for i in range(5)]
# Fixed report order of the model rows (as a report would list them).
MODEL_ORDER = ["MACHINERY", "BUILDING", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"]
# Fixed display names of the models.
DISPLAY = {"AUTOMOBILE": "Auto", "BUILDING": "Bldg", "FURNITURE": "Furn", "HOUSEHOLD": "Home", "MACHINERY": "Mach"}


def _score(a: int, b: int, m: int, div: float) -> str:
    return f"((c_custkey * {a} + seed * {b}) % {m}) / {div}::DOUBLE"


RUNS = f"""(SELECT c_custkey AS run_id, CASE WHEN c_nationkey % 2 = 0 THEN 'reg' ELSE 'cls' END AS kind,
   c_mktsegment AS model_name, 'set' || CAST(c_nationkey % 5 AS VARCHAR) AS ftr_combo_name,
   CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'mrmr' END AS feature_selection,
   CASE WHEN c_custkey % 3 = 0 THEN 'smote' ELSE '' END AS upsample,
   CAST(seed AS INTEGER) AS seed,
   {_score(7, 13, 101, 100.0)} AS test_f1_micro, {_score(11, 3, 97, 100.0)} AS test_f1_macro,
   {_score(5, 17, 89, 100.0)} AS test_f1_weighted, {_score(3, 7, 83, 100.0)} AS train_f1_micro,
   {_score(13, 5, 79, 50.0)} AS test_mse
 FROM customer CROSS JOIN (SELECT unnest(range(0, 10)) AS seed) s)"""


def runs(spark, d):
    return td.run_results(spark, d)


@query("mean_std_by_key", sql=f"""
SELECT model_name, ftr_combo_name,
       round(avg(test_f1_micro), 6) AS test_f1_micro_mean, round(stddev_samp(test_f1_micro), 6) AS test_f1_micro_std,
       round(avg(test_f1_macro), 6) AS test_f1_macro_mean, round(stddev_samp(test_f1_macro), 6) AS test_f1_macro_std
FROM {RUNS} r GROUP BY 1, 2
""")
def mean_std_by_key(spark, d):
    """H2: mean and sample std of the scores per (model, feature set)."""
    return rp.mean_std(runs(spark, d), ["model_name", "ftr_combo_name"], ["test_f1_micro", "test_f1_macro"])


@query("nested_mean", sql=f"""
SELECT model_name, ftr_combo_name, round(avg(m), 6) AS test_f1_micro_mean, round(stddev_samp(s), 6) AS test_f1_micro_std
FROM (SELECT model_name, ftr_combo_name, seed, avg(test_f1_micro) AS m, stddev_samp(test_f1_micro) AS s
      FROM {RUNS} r GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def nested_mean(spark, d):
    """H3: mean of the per-seed means and std of the per-seed stds."""
    return rp.nested_mean(runs(spark, d), ["model_name", "ftr_combo_name"], "seed", ["test_f1_micro"])


_PIVOT = f"""SELECT model_name, {", ".join(f"round(avg(test_f1_micro) FILTER (WHERE ftr_combo_name = '{s}'), 6) AS {s}"
                                          for s in SETS)}
FROM {RUNS} r GROUP BY model_name"""


@query("pivot_metric", sql=_PIVOT)
def pivot_metric(spark, d):
    """H4: model x feature-set table of the mean micro F1."""
    return rp.pivot_metric(runs(spark, d), "model_name", "ftr_combo_name", "test_f1_micro", SETS)


@query("report_order", sql=f"""
SELECT *, CAST(CASE model_name {" ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(MODEL_ORDER))} END
               AS INTEGER) AS row_order
FROM ({_PIVOT})
""")
def report_order(spark, d):
    """H5: the pivot in the fixed row order of the report."""
    piv = rp.pivot_metric(runs(spark, d), "model_name", "ftr_combo_name", "test_f1_micro", SETS)
    return rp.with_order(piv, "model_name", MODEL_ORDER)


@query("baseline_broadcast", sql=f"""
{_PIVOT}
UNION ALL
SELECT 'baseline' AS model_name, {", ".join(f"round((SELECT avg(test_f1_micro) FROM {RUNS} b), 6) AS {s}" for s in SETS)}
""")
def baseline_broadcast(spark, d):
    """H6: a baseline row (overall mean) repeated under every column."""
    r = runs(spark, d)
    piv = rp.pivot_metric(r, "model_name", "ftr_combo_name", "test_f1_micro", SETS)
    base = r.agg(F.avg("test_f1_micro")).first()[0]
    return rp.add_baseline_row(piv, "model_name", "baseline", base)


@query("top_runs", sql=f"""
SELECT run_id, seed, model_name, test_f1_micro FROM {RUNS} r
ORDER BY test_f1_micro DESC, run_id, seed LIMIT 10
""")
def top_runs(spark, d):
    """H7: the ten best runs (top-k report)."""
    r = runs(spark, d).select("run_id", "seed", "model_name", "test_f1_micro")
    return rp.top_n(r, [F.desc("test_f1_micro"), "run_id", "seed"], 10)


@query("top_per_group", sql=f"""
SELECT run_id, seed, model_name, test_f1_weighted, rank FROM (
  SELECT run_id, seed, model_name, test_f1_weighted,
         CAST(row_number() OVER (PARTITION BY model_name ORDER BY test_f1_weighted DESC, run_id, seed) AS INTEGER)
           AS rank FROM {RUNS} r) WHERE rank <= 3
""")
def top_per_group(spark, d):
    """H8: top three runs per model."""
    r = runs(spark, d).select("run_id", "seed", "model_name", "test_f1_weighted")
    return rp.top_n_per_group(r, ["model_name"], [F.desc("test_f1_weighted"), "run_id", "seed"], 3)


@query("max_per_threshold", sql=f"""
SELECT ftr_combo_name, max(test_f1_micro) AS max_f1_micro FROM {RUNS} r GROUP BY 1
""")
def max_per_threshold(spark, d):
    """H9: best score per parameter value."""
    return runs(spark, d).groupBy("ftr_combo_name").agg(F.max("test_f1_micro").alias("max_f1_micro"))


def _fixed3_sql(x: str) -> str:
    micro = f"CAST(round(({x}) * 1000000.0::DOUBLE, 0) AS BIGINT)"
    n = f"(({micro} + 500) // 1000)"
    return f"(CAST({n} // 1000 AS VARCHAR) || '.' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0'))"


@query("best_per_scheme", sql=f"""
WITH M AS (SELECT ftr_combo_name, model_name, feature_selection, avg(test_f1_micro) AS m FROM {RUNS} r GROUP BY 1, 2, 3),
R AS (SELECT *, row_number() OVER (PARTITION BY ftr_combo_name ORDER BY m DESC, model_name, feature_selection) AS rk
      FROM M)
SELECT ftr_combo_name, round(max(m), 6) AS max_,
       string_agg(concat_ws(' ', model_name, feature_selection, {_fixed3_sql('m')}), '; ' ORDER BY rk) AS str
FROM R WHERE rk <= 3 GROUP BY 1
""")
def best_per_scheme(spark, d):
    """The three best (model, selection) per feature set as one text line."""
    means = runs(spark, d).groupBy("ftr_combo_name", "model_name", "feature_selection").agg(
        F.avg("test_f1_micro").alias("m"))
    return rp.best_per_scheme(means, "ftr_combo_name", ["model_name", "feature_selection"], "m")


@query("union_runs", sql=f"""
SELECT run_id, kind, model_name, ftr_combo_name, feature_selection, '' AS upsample, seed, test_f1_micro
FROM {RUNS} r WHERE seed < 5
UNION ALL
SELECT run_id, kind, model_name, ftr_combo_name, feature_selection, upsample, seed, test_f1_micro
FROM {RUNS} r WHERE seed >= 5
""")
def union_runs(spark, d):
    """Union of run tables with different columns, blanks filled with ''."""
    r = runs(spark, d).select("run_id", "kind", "model_name", "ftr_combo_name", "feature_selection", "upsample",
                              "seed", "test_f1_micro")
    return rp.union_runs([r.filter(F.col("seed") < 5).drop("upsample"), r.filter(F.col("seed") >= 5)])


@query("histogram", sql=f"""
SELECT CAST(least(CASE WHEN test_f1_micro >= 1.0 THEN 11 ELSE CAST(floor(10 * (test_f1_micro - 0.0) / (1.0 - 0.0))
                                                                   AS BIGINT) + 1 END, 10) AS BIGINT) AS bin,
       count(*) AS n
FROM {RUNS} r WHERE test_f1_micro BETWEEN 0.0 AND 1.0 GROUP BY 1
""")
def histogram(spark, d):
    """Ten equal-width bins over [0, 1]; 1.0 falls into the last bin."""
    return rp.histogram(runs(spark, d), "test_f1_micro", 0.0, 1.0, 10)


@query("box_stats", sql=f"""
""" + "\nUNION ALL\n".join(
    f"SELECT model_name, {q}::DOUBLE AS q, round(quantile_cont(test_f1_micro, {q}), 6) AS value "
    f"FROM {RUNS} r GROUP BY 1" for q in (0.25, 0.5, 0.75)) + """
""")
def box_stats(spark, d):
    """Exact quartiles per model (linear interpolation)."""
    return rp.exact_quantiles(runs(spark, d).select("model_name", "test_f1_micro"), "test_f1_micro",
                              ["model_name"], [0.25, 0.5, 0.75])


_SEGF = """(SELECT c.c_custkey AS index_seg, c.c_acctbal AS acctbal, o.n_orders, o.avg_price, l.csl
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_price
                             FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT o_custkey, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS csl FROM orders GROUP BY 1) l
  ON c.c_custkey = l.o_custkey)"""


@query("pearson_by_feature", sql="\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, round(corr({f}, csl), 6) AS r, count({f}) FILTER (WHERE csl IS NOT NULL) AS n,
       round(corr({f}, csl) * sqrt((count({f}) FILTER (WHERE csl IS NOT NULL) - 2)
             / (1.0 - corr({f}, csl) * corr({f}, csl))), 6) AS t FROM {_SEGF} x"""
    for f in ["acctbal", "n_orders", "avg_price"]))
def pearson_by_feature(spark, d):
    """Pearson r of each feature with the label, n and t."""
    x = td.segment_features(spark, d).join(td.labels(spark, d), td.KEY, "left")
    return rp.pearson(x, ["acctbal", "n_orders", "avg_price"], "csl")


@query("pearson_p")
def pearson_p(spark, d):
    """Pearson r with the Student-t p value and stars (p has no SQL
    counterpart; r and t are checked by pearson_by_feature)."""
    x = td.segment_features(spark, d).join(td.labels(spark, d), td.KEY, "left")
    return rp.pearson_with_p(x, ["acctbal", "n_orders", "avg_price"], "csl")


@query("metric_agreement", sql=f"""
SELECT model_name, round(avg(CASE WHEN test_f1_micro = train_f1_micro THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS agreement
FROM {RUNS} r GROUP BY 1
""")
def metric_agreement(spark, d):
    """Share of runs where two metrics coincide."""
    return rp.agreement(runs(spark, d), "test_f1_micro", "train_f1_micro", ["model_name"])


@query("slice_runs", sql=f"""
SELECT run_id, seed, feature_selection, upsample, test_f1_micro FROM {RUNS} r
WHERE (feature_selection = 'mrmr' OR feature_selection = '') AND (upsample = 'smote' OR upsample = '')
  AND model_name = 'BUILDING' AND kind = 'cls'
""")
def slice_runs(spark, d):
    """Compound tag filter where a blank tag also matches."""
    r = runs(spark, d)
    cond = (((F.col("feature_selection") == "mrmr") | (F.col("feature_selection") == ""))
            & ((F.col("upsample") == "smote") | (F.col("upsample") == ""))
            & (F.col("model_name") == "BUILDING") & (F.col("kind") == "cls"))
    return r.filter(cond).select("run_id", "seed", "feature_selection", "upsample", "test_f1_micro")


@query("map_labels", sql=f"""
SELECT DISTINCT model_name, CASE model_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items())}
  ELSE model_name END AS display, split_part(kind || '-' || ftr_combo_name, '-', 1) AS kind_part
FROM {RUNS} r
""")
def map_labels(spark, d):
    """Display names by lookup, and the text before the first '-'."""
    r = runs(spark, d).withColumn("tag", F.concat_ws("-", "kind", "ftr_combo_name"))
    return r.select("model_name", rp.display_names("model_name", DISPLAY).alias("display"),
                    F.split(F.col("tag"), "-", 2)[0].alias("kind_part")).distinct()


@query("run_key", sql=f"""
SELECT run_id, seed, concat_ws(' ', kind, model_name, ftr_combo_name, feature_selection, upsample) AS run_key
FROM {RUNS} r
""")
def run_key(spark, d):
    """Space-joined run key that keeps blank parts."""
    r = runs(spark, d)
    return r.select("run_id", "seed", rp.run_key(["kind", "model_name", "ftr_combo_name", "feature_selection",
                                                   "upsample"]).alias("run_key"))


@query("means_with_info", sql=f"""
WITH M AS (SELECT model_name, ftr_combo_name, avg(test_f1_micro) AS test_f1_micro FROM {RUNS} r GROUP BY 1, 2),
I AS (SELECT model_name, count(*) AS n_runs, count(DISTINCT seed) AS n_seeds FROM {RUNS} r GROUP BY 1)
SELECT M.model_name, ftr_combo_name, round(test_f1_micro, 6) AS test_f1_micro, n_runs, n_seeds
FROM M LEFT JOIN I ON M.model_name = I.model_name
""")
def means_with_info(spark, d):
    """Means joined with run information on the shared key columns."""
    r = runs(spark, d)
    means = r.groupBy("model_name", "ftr_combo_name").agg(F.avg("test_f1_micro").alias("test_f1_micro"))
    info = r.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("seed").alias("n_seeds"))
    shared = [c for c in means.columns if c in info.columns]
    return means.join(info, shared, "left")


@query("pending_runs", sql=f"""
WITH P AS (SELECT m.model_name, f.ftr_combo_name, CAST(s.seed AS INTEGER) AS seed
           FROM (SELECT DISTINCT model_name FROM {RUNS} r) m
           CROSS JOIN (SELECT DISTINCT ftr_combo_name FROM {RUNS} r) f
           CROSS JOIN (SELECT unnest(range(0, 12)) AS seed) s),
D AS (SELECT DISTINCT model_name, ftr_combo_name, seed FROM {RUNS} r WHERE kind = 'cls' AND seed < 8)
SELECT * FROM P WHERE NOT EXISTS (
  SELECT 1 FROM D WHERE D.model_name = P.model_name AND D.ftr_combo_name = P.ftr_combo_name AND D.seed = P.seed)
""")
def pending_runs(spark, d):
    """A10: planned runs (models x feature sets x 12 seeds) still missing from
    the results (classification runs of seeds 0..7 are done)."""
    r = runs(spark, d)
    plan = rp.run_plan({"model_name": r.select("model_name"), "ftr_combo_name": r.select("ftr_combo_name"),
                        "seed": list(range(12))})
    done = r.filter((F.col("kind") == "cls") & (F.col("seed") < 8))
    return rp.pending_runs(plan, done, ["model_name", "ftr_combo_name", "seed"])


# Fixed allow-list of (model, selection, resampling) combinations to run.
ALLOW = [("BUILDING", "", ""), ("BUILDING", "mrmr", "smote"), ("MACHINERY", "rfecv_linsvc", ""),
         ("HOUSEHOLD", "mrmr", "")]


@query("run_plan", sql=f"""
WITH A AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ALLOW)})
           v(model_name, feature_selection, upsample))
SELECT m.model_name, f.ftr_combo_name, s.feature_selection, u.upsample
FROM (SELECT DISTINCT model_name FROM {RUNS} r) m
CROSS JOIN (SELECT DISTINCT ftr_combo_name FROM {RUNS} r) f
CROSS JOIN (SELECT unnest(['', 'mrmr', 'rfecv_linsvc']) AS feature_selection) s
CROSS JOIN (SELECT unnest(['', 'smote']) AS upsample) u
WHERE EXISTS (SELECT 1 FROM A WHERE A.model_name = m.model_name AND A.feature_selection = s.feature_selection
              AND A.upsample = u.upsample)
""")
def run_plan(spark, d):
    """Experiment plan = models x feature sets x selection x resampling,
    restricted to an allow-list."""
    r = runs(spark, d)
    allow = spark.createDataFrame(ALLOW, "model_name string, feature_selection string, upsample string")
    return rp.run_plan({"model_name": r.select("model_name"), "ftr_combo_name": r.select("ftr_combo_name"),
                        "feature_selection": ["", "mrmr", "rfecv_linsvc"], "upsample": ["", "smote"]}, allow)


@query("fixed_text", sql=f"""
SELECT run_id, seed, {_fixed3_sql('test_f1_micro * 0.987')} AS score_text FROM {RUNS} r
""")
def fixed_text(spark, d):
    """B13 helper: engine-independent fixed-point text of a score."""
    r = runs(spark, d)
    return r.select("run_id", "seed", fixed_decimals(F.col("test_f1_micro") * F.lit(0.987), 3).alias("score_text"))


def _scratch(spark, name: str) -> str:
    import uuid

    from segstats.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("scan_run_files", sql=f"""
SELECT run_id, test_f1_micro, model_name, CAST(seed AS VARCHAR) AS seed FROM {RUNS} r
""")
def scan_run_files(spark, d):
    """A4: run results written as one CSV folder per (model, seed) and read
    back in one scan with the tags recovered from the file paths."""
    from segstats.sources.runs import scan_with_path_tags
    path = _scratch(spark, "runs")
    r = runs(spark, d).select("run_id", "model_name", "seed", "test_f1_micro")
    r.write.partitionBy("model_name", "seed").option("header", True).csv(path)
    schema = "run_id long, test_f1_micro double"
    return scan_with_path_tags(spark, f"{path}/*/*/*.csv", {"model_name": r"model_name=([^/]+)",
                                                              "seed": r"seed=(\d+)"}, "csv", schema, header=True)


_SPLIT972 = f"""(SELECT index_seg, CASE WHEN rk <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part
  FROM (SELECT c_custkey AS index_seg, row_number() OVER (ORDER BY {portable_hash_sql('c_custkey', '972')}, c_custkey) AS rk,
               count(*) OVER () AS n FROM customer))"""


@query("persisted_split", sql=f"SELECT index_seg, part, part AS part_first FROM {_SPLIT972} s")
def persisted_split(spark, d):
    """The split of one seed is stored on first use and reloaded after."""
    from segstats.operators import sampling as sp
    from segstats.sources.runs import persisted_split as ps
    path = _scratch(spark, "split")
    seg = td.segments(spark, d).select(td.KEY)
    first = ps(spark, path, lambda: sp.split_80_20(seg, 972))
    again = ps(spark, path, lambda: sp.split_80_20(seg, 5258))  # not rebuilt: reuses the stored ids
    return again.join(first.withColumnRenamed("part", "part_first"), td.KEY)


@query("stream_runs", sql=f"""
SELECT run_id, model_name, seed, test_f1_micro, CASE WHEN seed < 6 THEN 0 ELSE 1 END AS ingest_epoch FROM {RUNS} r
""")
def stream_runs(spark, d):
    """A10 as a stream: run-result files arrive in two waves (the second
    repeats part of the first); an availableNow stream appends each run once."""
    from segstats.streaming.results import ingest_runs, read_runs
    src, table, ckpt = _scratch(spark, "incoming"), _scratch(spark, "runs-table"), _scratch(spark, "stream-ckpt")
    r = runs(spark, d).select("run_id", "model_name", "seed", "test_f1_micro")
    r.filter(F.col("seed") < 6).write.parquet(f"{src}/wave1")
    ingest_runs(spark, f"{src}/*", r.schema, table, ckpt, ["run_id", "seed"], buckets=16)
    r.filter(F.col("seed") >= 4).write.parquet(f"{src}/wave2")
    ingest_runs(spark, f"{src}/*", r.schema, table, ckpt, ["run_id", "seed"], buckets=16)
    return read_runs(spark, table)
