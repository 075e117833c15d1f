"""Tables of facts about scripts: assignments, chains, calls, lineage, columns, predicates, gaps.

Input is a table ``(script_id, content)``. Every job here is a scan, projections and generators: no
shuffle, no Python in the tasks, and whole texts throughout. A script is one row, at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.scripts.patterns import (
    GROUPED_CALLS,
    KNOWN_CALLS,
    LOOSE_GROUPING,
    NAME,
    ORDER_CHANGES_MEANING,
    QUOTED,
    SPARK,
)


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def call_name(call: Column | str) -> Column:
    return F.regexp_extract(call, rf"^\.\s*({NAME})", 1)


def judged_call(step: Column) -> Column:
    return F.struct(
        call_name(step).alias("op"), step.rlike(SPARK.readable_call).alias("readable"), strings(step).alias("quoted")
    )


def strings(call: Column | str) -> Column:
    """The quoted strings of a call, without their quotes."""
    return all_matches(call, QUOTED, 1)


def names(quoted: Column) -> Column:
    """Column names in the quoted strings of a call; several may be packed in one string."""
    return F.filter(F.transform(F.split(F.array_join(quoted, ","), ","), lambda n: F.trim(n)), lambda n: n != "")


# Keyword of SQL for a spelled join type (lower case, blanks, "_", "outer", "join" removed).
JOIN_KEYWORDS = {
    "inner": "INNER",
    "cross": "CROSS",
    "left": "LEFT OUTER",
    "right": "RIGHT OUTER",
    "full": "FULL OUTER",
    "": "FULL OUTER",
    "semi": "LEFT SEMI",
    "leftsemi": "LEFT SEMI",
    "anti": "LEFT ANTI",
    "leftanti": "LEFT ANTI",
}


def join_keyword(spelled: Column) -> Column:
    """SQL keyword of a spelled join type; inner when none is given."""
    keywords = F.create_map(*[F.lit(text) for pair in JOIN_KEYWORDS.items() for text in pair])
    key = F.regexp_replace(F.lower(F.coalesce(spelled, F.lit("inner"))), r"[\s_]+|outer|join", "")
    return F.try_element_at(keywords, key)


def clean(scripts: DataFrame) -> DataFrame:
    """Comments removed; comment signs inside strings stay."""
    return scripts.withColumn("content", F.regexp_replace("content", SPARK.comment, "$1"))


def assignments(scripts: DataFrame) -> DataFrame:
    """One row per ``val x = ...``: its variable, and its chain if it holds one.

    ``whole`` is false where the arguments of the last call could not be read to their end.
    """
    found = clean(scripts).select("script_id", F.posexplode(all_matches("content", SPARK.assignment)).alias("chain_no", "text"))
    is_chain = ~F.col("text").rlike(r"=$")
    return found.select(
        "script_id",
        "chain_no",
        F.regexp_extract("text", r"^val\s+(\w+)", 1).alias("variable"),
        F.when(is_chain, F.regexp_extract("text", rf"=\s*({NAME})", 1)).alias("root"),
        F.when(is_chain, F.col("text")).alias("chain"),
        F.when(is_chain, ~F.col("text").rlike(r"[({\[]$")).alias("whole"),
    )


def chains(scripts: DataFrame) -> DataFrame:
    return assignments(scripts).filter(F.col("chain").isNotNull())


def calls(chains_df: DataFrame) -> DataFrame:
    """One row per call of a chain, in order; ``readable`` tells whether the SQL form understands it."""
    steps = chains_df.select("script_id", "chain_no", F.posexplode(all_matches("chain", SPARK.call)).alias("step_no", "step"))
    return steps.select(
        "script_id",
        "chain_no",
        "step_no",
        call_name("step").alias("op"),
        "step",
        F.col("step").rlike(SPARK.readable_call).alias("readable"),
    )


def lineage(calls_df: DataFrame) -> DataFrame:
    """Edges from chains to the tables they read or join."""
    is_join, quoted = F.col("op") == "join", strings("step")
    return calls_df.filter(F.col("op").isin("table", "join") & F.col("readable")).select(
        "script_id",
        "chain_no",
        "step_no",
        F.when(is_join, "join").otherwise("from").alias("role"),
        F.get(quoted, 0).alias("tbl"),
        F.when(is_join, join_keyword(F.get(quoted, 2))).alias("join_type"),
        F.when(is_join, F.get(quoted, 1)).alias("cond"),
    )


def columns(calls_df: DataFrame) -> DataFrame:
    """Columns that chains select and group by."""
    used = calls_df.filter(F.col("op").isin("select", "groupBy") & F.col("readable"))
    return used.select("script_id", "chain_no", "op", F.explode(names(strings("step"))).alias("name"))


def predicates(calls_df: DataFrame) -> DataFrame:
    used = calls_df.filter(F.col("op").isin("filter", "where") & F.col("readable"))
    return used.select("script_id", "chain_no", F.get(strings("step"), 0).alias("predicate"))


def order_problem(ops: Column, quoted: Column, from_star: bool = False) -> Column:
    """Whether the order of calls means something that one query block cannot say.

    ``from_star`` tells that a block can take a column out of ``*`` that is derived from itself.
    """
    text = F.concat(F.lit(" "), F.array_join(ops, " "), F.lit(" "))
    ungrouped = F.regexp_replace(text, GROUPED_CALLS, " ").rlike(LOOSE_GROUPING)
    return text.rlike(ORDER_CHANGES_MEANING) | ungrouped | _names_clash(ops, quoted, from_star) | _filter_before_outer_join(ops, quoted)


def _names_clash(ops: Column, quoted: Column, from_star: bool) -> Column:
    """Whether the names that calls make get in the way of each other, in a chain without groups.

    A later filter, join or derived column reads or makes such a name again (WHERE, ON and the select list do
    not see the select list's names), a later select leaves a derived column out, or a column is derived from
    itself where no select tells which columns there are.
    """

    def new_name(strings_of: Column, i: Column) -> Column:
        op = F.get(ops, i)
        return F.when(op == "withColumn", F.get(strings_of, 0)).when(op == "withColumnRenamed", F.get(strings_of, 1))

    def words(strings_of: Column, i: Column) -> Column:
        op = F.get(ops, i)
        read = F.when(op.isin("filter", "where"), F.get(strings_of, 0)).when(op == "join", F.get(strings_of, 1))
        return F.split(read.when(op == "withColumn", F.array_join(strings_of, " ")), r"\W+")

    def derived_and_left_out(strings_of: Column, i: Column) -> Column:
        derived = F.filter(F.transform(F.slice(quoted, 1, i), lambda q, k: F.when(F.get(ops, k) == "withColumn", F.get(q, 0))), lambda n: n.isNotNull())
        return (F.get(ops, i) == "select") & (F.size(F.array_except(derived, names(strings_of))) > 0)

    made = F.transform(quoted, new_name)
    clashes = F.transform(F.transform(quoted, words), lambda w, i: F.arrays_overlap(w, F.slice(made, 1, i)))
    left_out = F.array_contains(F.transform(quoted, derived_and_left_out), True)
    doubled = F.exists(from_themselves(ops, quoted), lambda n: n.isNotNull()) & ~F.array_contains(ops, "select") & F.lit(not from_star)
    renamed = F.array_contains(ops, "withColumn") | F.array_contains(ops, "withColumnRenamed")
    any_ = F.array_contains(clashes, True).eqNullSafe(True) | left_out.eqNullSafe(True) | doubled.eqNullSafe(True)
    return F.when(renamed & ~F.array_contains(ops, "groupBy"), any_).otherwise(False).eqNullSafe(True)


def from_themselves(ops: Column, quoted: Column) -> Column:
    """The name that each call derives a column of from that column itself, or NULL."""

    def name(strings_of: Column, i: Column) -> Column:
        sources = F.split(F.array_join(F.slice(strings_of, 2, F.greatest(F.size(strings_of) - 1, F.lit(0))), " "), r"\W+")
        return F.when((F.get(ops, i) == "withColumn") & F.array_contains(sources, F.get(strings_of, 0)), F.get(strings_of, 0))

    return F.transform(quoted, name)


def _filter_before_outer_join(ops: Column, quoted: Column) -> Column:
    """Whether a right or full join comes after a filter: WHERE would also take the rows it keeps from its right side."""

    def late(strings_of: Column, i: Column) -> Column:
        outer = join_keyword(F.get(strings_of, 2)).isin("RIGHT OUTER", "FULL OUTER")
        return (F.get(ops, i) == "join") & outer & F.arrays_overlap(F.slice(ops, 1, i), F.array(F.lit("filter"), F.lit("where")))

    return F.when(F.array_contains(ops, "join"), F.array_contains(F.transform(quoted, late), True)).otherwise(False).eqNullSafe(True)


def unsupported(scripts: DataFrame) -> DataFrame:
    """Whatever keeps an assignment from having SQL text, one row per finding.

    Reasons: ``no chain``, ``unknown call``, ``unread arguments``, ``order of calls``.
    """
    found = assignments(scripts)
    judged = found.withColumn("steps", F.transform(all_matches("chain", SPARK.call), judged_call))
    judged = judged.withColumns({"ops": F.transform("steps", lambda s: s["op"]), "quoted": F.transform("steps", lambda s: s["quoted"])})
    judged = judged.withColumn("disordered", order_problem(F.col("ops"), F.col("quoted")))

    def finding(reason: str | Column, op: Column) -> Column:
        return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), op.alias("op"))

    nothing = F.lit(None).cast("string")
    unread = F.filter("steps", lambda s: ~s["readable"])
    cut_off = F.filter(F.slice("steps", -1, 1), lambda s: s["readable"] & ~F.col("whole"))
    findings = F.when(F.col("chain").isNull(), F.array(finding("no chain", nothing))).otherwise(
        F.concat(
            F.transform(
                F.concat(unread, cut_off),
                lambda s: finding(F.when(s["op"].isin(*KNOWN_CALLS), "unread arguments").otherwise("unknown call"), s["op"]),
            ),
            F.when(F.col("disordered"), F.array(finding("order of calls", nothing))).otherwise(F.array()),
        )
    )
    return judged.select("script_id", "chain_no", F.inline(findings))
