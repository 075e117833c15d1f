"""Queries that SQL can express give the rows, names and types of that SQL."""

import os

import duckdb
import pytest

from blockquery.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, FOLDER), con.execute(queries.SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(tuple, ours.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)
