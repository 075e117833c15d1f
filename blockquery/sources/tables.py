"""Tables by name. A lookup is a function from a table name to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockquery.functions.names import quote

TableLookup = Callable[[str], DataFrame]


def catalog_tables(spark: SparkSession, namespace: str | None = None) -> TableLookup:
    """Tables and views of the session catalog, each name prefixed with ``namespace`` when given."""
    prefix = f"{quote(namespace)}." if namespace else ""
    return lambda name: spark.read.table(prefix + quote(name))


def parquet_tables(spark: SparkSession, folder: str) -> TableLookup:
    """Tables stored as ``<folder>/<name>.parquet`` (a file, or a folder of files)."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
