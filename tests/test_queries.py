"""Every named query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from sunloom.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    want = con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda r: tuple((v is None, str(round(v, 3) if isinstance(v, float) else v)) for v in r)
    a = sorted(map(tuple, got.select(*names).collect()), key=key)
    b = sorted(want.project(", ".join(f'"{n}"' for n in names)).fetchall(), key=key)
    assert len(a) == len(b) > 0  # a query without rows would show nothing
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_fitted_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_scans_are_pruned(spark):
    plan = QUERIES["date_slice"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan
