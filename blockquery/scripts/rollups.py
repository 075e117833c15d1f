"""Counts over a whole corpus. Each groups with map-side aggregation, so a hot value costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.scripts.facts import all_matches, call_name, strings
from blockquery.scripts.patterns import SPARK


TABLE_CALL = r"^\.\s*(?:table|join)\b"


def table_use(step: Column) -> Column:
    """The table that a readable call reads or joins."""
    name = F.when(step.rlike(SPARK.readable_call), F.get(strings(step), 0))
    return F.struct(call_name(step).alias("op"), name.alias("name"))


def op_counts(calls_df: DataFrame) -> DataFrame:
    return calls_df.groupBy("op").count()


def table_popularity(lineage_df: DataFrame) -> DataFrame:
    """How often each table is read or joined."""
    return lineage_df.groupBy("tbl").count()


def join_pairs(chains_df: DataFrame) -> DataFrame:
    """How often each table is joined to each base table. One row per join, made inside the chain's row."""
    readable = chains_df.select(F.filter(all_matches("chain", SPARK.call), lambda s: s.rlike(TABLE_CALL)).alias("steps"))
    tables = readable.filter(F.size("steps") > 1).select(F.transform("steps", table_use).alias("uses"))
    base = F.get(F.filter("uses", lambda u: u["op"] == "table"), 0)["name"]
    joined = F.filter("uses", lambda u: (u["op"] == "join") & u["name"].isNotNull())
    pairs = tables.select(base.alias("base"), F.explode(joined["name"]).alias("joined")).filter(F.col("base").isNotNull())
    return pairs.groupBy("base", "joined").count()
