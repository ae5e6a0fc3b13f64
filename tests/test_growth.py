"""What a task holds must not grow with the table: small tables of own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.sources import testdata as td


def table(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(7 * i % 23, 1 + i % 4, "F", None, f"{1 + i * i % 5}-X") for i in range(60)]
    rows += [rows[3], rows[3], (-5, 2, "O", None, "5-X"), (None, 2, "O", None, "1-X"), (9, None, "O", None, "2-X"), (4, 3, "P", None, None)]
    return table(spark, tmp_path, "orders", rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string")


def test_predictions_of_seeds_are_spelled_out_after_the_sums(spark, orders):
    got = td.truth_pred_seeds(spark, orders, 4)
    r = td.order_ratings(spark, orders).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3))))
    want = r.groupBy(td.KEY, "seed").agg(
        F.avg("rating").alias("t"), F.coalesce(F.avg(F.when((F.col("o_orderkey") + F.col("seed")) % 3 == 0, F.col("rating"))), F.lit(0.0)).alias("r"))
    want = want.select(td.KEY, "seed", td.bounded_round("t", 1, 5).alias("y_true"), td.bounded_round("r", 1, 5).alias("y_pred"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Aggregate")  # top down: sums first, one row per key


def test_runs_of_one_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    rows = [(i % 50 if i % 3 else 7, i % 4, "A" if i % 5 else None) for i in range(400)]  # repeated and frequent keys, one file
    df = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1)
    df.write.parquet(f"{tmp_path}/customer.parquet")
    want = sorted(map(str, td.run_results(spark, str(tmp_path)).collect()))
    monkeypatch.setattr("segstats.session.TASK_ROWS", 500)
    runs = td.run_results(spark, str(tmp_path))
    sizes = [r["count"] for r in runs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 500
    assert sorted(map(str, runs.collect())) == want and len(want) == 4000


def test_neighbours_are_found_without_rows_of_pairs(spark, monkeypatch):
    from segstats.operators.spatial import weights as wt

    def no_pairs(*a, **k):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(wt, "pair_candidates", no_pairs)
    lattice = [(i, float(i % 17), float(i // 17)) for i in range(150)]  # ties everywhere
    rows = [(g, *r) for g in "ab" for r in lattice] + [("b", 200 + i, 3.0, 4.0) for i in range(9)]  # one spot
    rows += [("a", 300, None, 1.0), ("a", None, 2.0, 2.0), (None, 301, 1.0, 1.0), ("c", 302, 0.0, 0.0), ("a", 303, 1e6, -1e6)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double").repartition(3)
    got = {}
    for r in wt.knn(df, 5, by=["g"], dense_rows=20).collect():
        got.setdefault((r["g"], r["src"]), {})[r["rank"]] = (r["d"], r["dst"])
    live = [r for r in rows if None not in r]
    for g, i, x, y in live:
        want = sorted((((x - b[2]) ** 2 + (y - b[3]) ** 2) ** 0.5, b[1]) for b in live if b[0] == g and b[1] != i)[:5]
        assert [v for _, v in sorted(got.pop((g, i), {}).items())] == want
    assert not got


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_features_are_assembled_once_for_all_seeds(spark, monkeypatch):
    from segstats.plans import model_queries as mq

    x = spark.createDataFrame([(i, *[float(i * j % 7) for j in range(1, 8)], 1 + i % 9 / 2) for i in range(60)],
                              ", ".join(["index_seg long", *[f"{c} double" for c in mq.COLS], "csl double"]))
    monkeypatch.setattr(mq, "assemble", lambda *a: x.drop("csl"))
    monkeypatch.setattr(mq.td, "labels", lambda *a: x.select("index_seg", "csl"))
    monkeypatch.setattr(mq, "SPLIT_SEEDS", [0, 100])
    calls = counted(monkeypatch, mq, "assemble")
    assert mq.importance_summary(spark, "").count() == len(mq.COLS) and len(calls) == 1


def test_runs_of_a_seed_share_its_split(spark, tmp_path, monkeypatch):
    from segstats.operators import experiments as ex
    from segstats.operators import reports as rp

    x = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), 1 + i % 9 / 2) for i in range(60)], "index_seg long, a double, b double, csl double")
    plan = rp.run_plan({"seed": [0], "ftr_combo_name": ["one", "two"], "feature_selection": ["", "variance"], "upsample": [""], "model_name": ["ridge"]}, spark=spark)
    calls = counted(monkeypatch, ex.sp, "split_80_20")
    rows = ex.run_experiments(plan, x, {"one": ["a"], "two": ["b", "a"]}, f"{tmp_path}/runs").collect()
    assert len(rows) == 4 and len(calls) == 1
    assert {r["n_train"] for r in rows} == {48} and {r["n_test"] for r in rows} == {12}
    assert {r["ftr_combo_name"]: r["n_features"] for r in rows} == {"one": 1, "two": 2}


def test_results_are_rounded_without_a_decimal_for_each_value(spark):
    from segstats.functions.expressions import round_doubles

    rng = np.random.default_rng(3)
    values = [0.0, -0.0, -4e-7, 5e-7, -5e-7, 2.5e-6, 0.1234565, -0.1234565, 1.0000005, 20.0000015, 1e300, -1e300, 5e-324, 123456789.0000005, 2e6 + 0.5,
              1e15 + 0.3, float("inf"), float("-inf"), float("nan"), None]
    values += [float(v) for s in (1e-6, 0.05, 60, 1e6, 1e12) for v in rng.normal(size=400) * s]  # odd digits
    values += [float(v) / 1e7 for v in rng.integers(-10**9, 10**9, 400) * 10 + 5]  # ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = round_doubles(df, 6)
    want = df.select("i", F.round("v", 6).alias("v"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()  # F.round is left to values near a tie
