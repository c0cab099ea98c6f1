"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    return connection


def comparable(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(comparable(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    expected = sorted((tuple(comparable(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
