"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert "index_seg" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cols = df.columns
    cur = con.execute(SQL[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    order = sorted(cols)
    a = sorted(tuple(_norm(r[cols.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert a == b


def test_queries_without_sql_have_property_tests():
    """Every query that SQL cannot express is checked by name in test_model_queries.py."""
    from segstats.plans import ORACLE_SQL
    from segstats.plans import QUERIES as OWN
    from tests.test_model_queries import CHECKED

    assert set(OWN) - set(ORACLE_SQL) <= set(CHECKED)
