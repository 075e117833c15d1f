"""Every registered query gives the rows, column names and types of its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from blockquery.operators import windows
from blockquery.plans.registry import QUERIES, SQL

HOT_ROWS = {
    "window_row_number": 10,
    "window_lag_lead": 66,
    "window_moving_avg": 66,
    "window_running_sum": 66,
    "window_rank_dense": 20,
    "window_rank_multi": 10,
}
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Spark's type name -> the type that stands for it in the other engine.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows):
    def key(row):
        return tuple((v is None, str(v)) for v in row)

    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=key)


def check(spark, duck, name):
    ours = spark_entry.queries()[name](spark, FOLDER)
    theirs = duck.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    types = dict(zip(names, [str(d[1]) for d in theirs.description]))
    assert sorted(ours.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in ours.dtypes} == types
    expected = ordered(theirs.fetchall())
    assert expected
    actual = ordered(map(tuple, ours.select(*[f"`{n}`" for n in names]).collect()))
    assert actual == expected


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", sorted(n for n in spark_entry.oracle_sql() if n.startswith("window_")))
def test_windows_with_hot_keys_split(spark, duck, name, monkeypatch):
    """About half of the users and customers, and every segment and brand, count as hot."""
    monkeypatch.setattr(windows, "HOT_ROWS", HOT_ROWS.get(name, 300))
    check(spark, duck, name)


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 10
