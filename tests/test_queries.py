"""Every registered query of the reference's operators against its DuckDB SQL, row by row."""

import datetime as dt
import math

import duckdb
import pytest

from barquet.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
