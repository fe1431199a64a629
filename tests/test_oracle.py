"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SQL = entry.oracle_sql()


def plain(value: object) -> object:
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.5g}"
    return "null" if value is None else str(value)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in at) for row in want.fetchall())
    found = sorted(tuple(plain(x) for x in row) for row in got.select(*columns).collect())
    assert found == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
