"""Every query with SQL gives the SQL's rows; every query runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in order]) for r in found.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
