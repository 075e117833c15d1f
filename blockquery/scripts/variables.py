"""Lineage through variables: the tables that a chain rests on, by way of the chains it starts from.

A chain that starts from a variable rests on what the last assignment of that name before it rests on. The
assignment that reaches each use is a running maximum over the assignments of a name, which the window operators
split where one name is assigned very often. Each chain has then at most one chain it starts from, and pointers
are doubled: in every round a chain takes over the tables of the chain it points to and its pointer, so a line
of ``n`` chains needs about ``log2(n)`` rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockquery.operators.windows import running
from blockquery.scripts import sql_text as block
from blockquery.scripts.facts import all_matches, assignments, call_name, strings
from blockquery.scripts.patterns import SPARK
from blockquery.sources.checkpoints import reliable, written


def reaching(assigned: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(script_id, chain_no, def_no)``: for each chain the last assignment of its root before it, if there is one."""
    uses = assigned.filter("chain IS NOT NULL").select("script_id", F.col("root").alias("name"), "chain_no", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("def"))
    made = assigned.select("script_id", F.col("variable").alias("name"), "chain_no", F.lit(1).alias("kind"), F.col("chain_no").alias("def"))
    # a use comes before the assignment it stands in: val a = a.filter(...) reads the a before
    placed = running(uses.union(made), ["script_id", "name"], ["chain_no", "kind"], {"def_no": ("max", "def")}, hot_rows)
    return placed.filter("kind = 0").select("script_id", "chain_no", "def_no")


def base_tables(scripts: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(script_id, chain_no, variable, tbl)``: every table that a chain reads or joins, itself or through variables.

    A chain that reads no table and starts from no chain rests on the table its names are qualified with, or on its
    root. A name that was last assigned something else than a chain is such a root. Only calls that can be read count.
    """
    assigned = reliable(assignments(scripts))
    parents = reaching(assigned, hot_rows)
    defined = assigned.filter("chain IS NOT NULL").select(F.col("script_id").alias("s"), F.col("chain_no").alias("c"))
    chain_of = parents.join(defined, (F.col("script_id") == F.col("s")) & (F.col("def_no") == F.col("c")), "left")
    chain_of = chain_of.select(F.col("script_id").alias("s"), F.col("chain_no").alias("c"), F.col("c").alias("ptr"))

    steps = F.filter(all_matches("chain", SPARK.call), lambda x: x.rlike(SPARK.readable_call))
    own = assigned.filter("chain IS NOT NULL").withColumn("steps", steps)
    own = own.withColumns({"ops": F.transform("steps", call_name), "quoted": F.transform("steps", strings)})
    named = F.filter("quoted", lambda _, i: F.get("ops", i).isin("table", "join"))
    own = own.withColumns({"tables": F.array_distinct(F.transform(named, lambda q: F.get(q, 0))), "reads": F.array_contains("ops", "table"), "leaf": block.base_table(None)})
    nodes = own.join(chain_of, (F.col("script_id") == F.col("s")) & (F.col("chain_no") == F.col("c")))
    stands_alone = ~F.col("reads") & F.col("ptr").isNull()
    tables = F.when(stands_alone, F.array_union("tables", F.array("leaf"))).otherwise(F.col("tables"))
    # a chain that reads a table starts there, whatever its root is called
    nodes = written(nodes.select("script_id", "chain_no", "variable", F.when(~F.col("reads"), F.col("ptr")).alias("ptr"), tables.alias("tables")))
    while not nodes.filter("ptr IS NOT NULL").isEmpty():
        below = nodes.select(F.col("script_id").alias("s"), F.col("chain_no").alias("c"), F.col("ptr").alias("further"), F.col("tables").alias("more"))
        joined = nodes.join(below, (F.col("script_id") == F.col("s")) & (F.col("ptr") == F.col("c")), "left")
        more = F.array_union("tables", F.coalesce("more", F.array().cast("array<string>")))
        nodes = written(joined.select("script_id", "chain_no", "variable", F.col("further").alias("ptr"), more.alias("tables")), instead_of=nodes)
    return nodes.select("script_id", "chain_no", "variable", F.explode("tables").alias("tbl"))
