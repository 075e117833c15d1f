"""SQL text of chains that one query block cannot say: blocks inside blocks.

A chain is cut where the order of its calls would mean something else in one block: a filter after a limit, a group
after a derived column, a name that one call makes and a later one reads. Each part is a block of its own and reads
from the one before, which goes by the name of the chain's base table, so names qualified with it still
resolve. Finding the parts is one pass per chain; only parts of the same chain meet again, by script and chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.scripts import sql_text as block
from blockquery.scripts.facts import all_matches, call_name, from_themselves, names, order_problem, strings
from blockquery.scripts.patterns import NAME, SPARK

_BELOW = "\u0001"
"""Stands for what a block reads from until the blocks are put together."""


def nested_sql_text(chains_df: DataFrame, namespace: str | None = None, base: str | None = None) -> DataFrame:
    """``(script_id, chain_no, variable, blocks, sql_text)``: the number of blocks and their text.

    The text is NULL, and so are the blocks, where a call cannot be read, aggregates have no group of their own, or an
    outer block reads a name that is qualified with another table than the base or the ones it joins itself.
    """
    split = chains_df.withColumn("steps", F.transform(all_matches("chain", SPARK.call), _unpacked_sort))
    read = split.withColumns({"ops": F.transform("steps", call_name), "quoted": F.transform("steps", strings)})
    read = read.withColumn("readable", F.col("whole") & F.forall("steps", lambda s: s.rlike(SPARK.readable_call)))
    read = read.withColumn("table", block.base_table(base))
    read = read.withColumn("starts", F.when(F.col("readable"), block_starts(F.col("ops"), F.col("quoted"))).otherwise(F.array(F.lit(0))))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("ops")))
    parts = read.select("script_id", "chain_no", "variable", "table", "readable", "root", "ops", "quoted", "steps", F.posexplode(F.arrays_zip("starts", ends.alias("ends"))).alias("no", "at"))
    size = F.col("at.ends") - F.col("at.starts")
    parts = parts.withColumns({c: F.slice(c, F.col("at.starts") + 1, F.greatest(size, F.lit(0))) for c in ("ops", "quoted", "steps")})
    sayable = F.col("readable") & ~order_problem(F.col("ops"), F.col("quoted"), from_star=True) & ((F.col("no") == 0) | ~_names_others())
    parts = parts.withColumn("sayable", sayable)
    parts = parts.withColumns({c: F.when(F.col("sayable"), F.col(c)) for c in ("steps", "ops", "quoted")})
    items = parts.withColumns(block.parts(namespace, base)).withColumn("tbl", F.lit(_BELOW)).withColumn("items", block.output_items())
    items = items.withColumn("items", _without_themselves()).withColumn("items", block.renamed_items())
    said = items.select("script_id", "chain_no", "variable", "table", "no", block.sql())
    whole = said.groupBy("script_id", "chain_no", "variable", "table").agg(F.sort_array(F.collect_list(F.struct("no", "sql_text"))).alias("said"))

    def put(below: Column, part: Column) -> Column:
        return F.replace(part["sql_text"], F.lit(_BELOW), F.when(part["no"] == 0, below).otherwise(F.concat(F.lit("("), below, F.lit(") AS "), _alias())))

    text = F.aggregate("said", block.table_text(F.col("table"), namespace), put)
    return whole.select("script_id", "chain_no", "variable", F.when(text.isNotNull(), F.size("said")).alias("blocks"), text.alias("sql_text"))


def _unpacked_sort(step: Column) -> Column:
    """A sort by strings that may hold several keys, as one by a string for each."""
    keys = F.array_join(names(strings(step)), '", "')
    return F.when(step.rlike(r'^\.\s*orderBy\s*\(\s*"[^"\n]*"(?:\s*,\s*"[^"\n]*")*\s*\)$'), F.concat(F.lit('.orderBy("'), keys, F.lit('")'))).otherwise(step)


def block_starts(ops: Column, quoted: Column) -> Column:
    """Places of the calls that begin a block: the first, and each that one block with those since the last start cannot hold."""

    def step(starts: Column, i: Column) -> Column:
        start = F.element_at(starts, -1)
        op, completes = F.get(ops, i), F.get(ops, i).isin("agg", "count") & (F.get(ops, i - 1) == "groupBy")
        more = F.when((op == "groupBy") & F.get(ops, i + 1).isin("agg", "count"), 2).otherwise(1)  # a group and its aggregates are one
        held = [F.slice(x, start + 1, i - start + more) for x in (ops, quoted)]
        return F.when(~completes & order_problem(*held, from_star=True), F.concat(starts, F.array(i))).otherwise(starts)

    # calls that one block cannot hold stay so when more follow, so a chain without a problem as a whole is one block
    later = F.sequence(F.lit(1), F.size(ops) - 1)
    several = (F.size(ops) > 1) & order_problem(ops, quoted, from_star=True)
    return F.when(several, F.aggregate(later, F.array(F.lit(0)), step)).otherwise(F.array(F.lit(0)))


def _alias() -> Column:
    return F.concat(F.lit("`"), F.regexp_extract("table", r"([^.]*)$", 1), F.lit("`"))


def _names_others() -> Column:
    """Whether a string of the calls has a qualifier that is neither the base table nor one that these calls join."""
    said = F.regexp_replace(F.array_join(F.flatten("quoted"), " "), r"'[^']*'", "")
    qualifiers = all_matches(said, rf"\b({NAME})\s*\.", 1)
    joined = F.transform(F.filter("quoted", lambda _, i: F.get("ops", i) == "join"), lambda q: F.get(q, 0))
    known = F.concat(F.transform(joined, lambda t: F.regexp_extract(t, r"([^.]*)$", 1)), F.array(F.regexp_extract("table", r"([^.]*)$", 1)))
    return F.size(F.array_except(qualifiers, known)) > 0


def _without_themselves() -> Column:
    """Columns derived from themselves are taken out of ``*``."""
    own = F.array_distinct(F.filter(from_themselves(F.col("ops"), F.col("quoted")), lambda n: n.isNotNull()))
    cut = F.aggregate(own, F.lit("*"), block.without)
    star = F.transform("items", lambda i: F.when(i["text"] == "*", block.item(cut, F.lit("*"), F.lit("*"))).otherwise(i))
    return F.when(F.size(own) > 0, star).otherwise(F.col("items"))
