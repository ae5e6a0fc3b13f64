"""Physical-plan properties that matter at scale (checked with explain)."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from segstats.operators import features as ft
from segstats.operators import reports as rp
from segstats.operators.spatial import weights as wt
from segstats.plans import QUERIES
from segstats.plans import feature_queries as fq
from segstats.plans import report_queries as rq
from segstats.sources import testdata as td
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_year_window_and_columns_reach_the_scan(spark):
    t = fq.feature_tables(spark, SF_SMALL, fq.YEARS)["orders"]
    plan = _plan(ft.prepare_table(t, "orders", fq.YEARS, "NO_TOTAL"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    assert plan.count("HashAggregate") >= 2  # partial + final


def test_top_n_per_group_limits_before_the_shuffle(spark):
    r = rq.runs(spark, SF_SMALL).select("run_id", "seed", "model_name", "test_f1_weighted")
    plan = _plan(rp.top_n_per_group(r, ["model_name"], [F.desc("test_f1_weighted"), "run_id", "seed"], 3))
    assert plan.count("WindowGroupLimit") >= 2


def test_band_join_is_an_equi_join(spark):
    plan = _plan(wt.distance_band(td.points(spark, SF_SMALL), 0.05))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan


def test_date_window_is_pushed_in_every_monthly_query(spark):
    for name in ("filter_year", "sum_per_segment", "left_population", "encode_columns"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan, name
