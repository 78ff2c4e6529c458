"""Every query of the catalogue against its SQL, on the smallest tables; and the shape of the driver's entry points."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from loomspan.plans import catalogue, records  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(catalogue.ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert len(cursor.description) == len(columns)
    assert got == sorted(repr([plain(row[i]) for i in order]) for row in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.prj02_conjunctive_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipinstruct" not in plan and "ReadSchema" in plan
    from loomspan.sources.deeds import table

    scan = table(spark, SF, "orders").filter("o_orderkey = 7").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in scan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in scan
