"""The SQL text of each chain, clause by clause, in SQL order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.scripts.facts import all_matches, call_name, join_keyword, names, order_problem, strings
from blockquery.scripts.patterns import NAME, SPARK

PLAIN_NAME = rf"^(?:{NAME}\.)*(?:{NAME}|\*)$"
AGGREGATE = r'(\w+)\s*\(\s*"([^"\n]*)"\s*\)(?:\s*\.\s*as\s*\(\s*"([^"\n]*)"\s*\))?'
ITEM = "struct<text: string, natural: string, name: string>"
SORT_KEY = r'(?:asc|desc)\s*\(\s*"[^"\n]*"\s*\)|"[^"\n]*"'


def sql_text(chains_df: DataFrame, namespace: str | None = None, base: str | None = None) -> DataFrame:
    """``(script_id, chain_no, sql_text)``; the text is NULL for chains that SQL cannot express.

    Tables are prefixed with ``namespace``. A chain's base table is the one it reads, else the qualifier of
    its first selected column, else ``base``, else the variable it starts from.
    """
    split = chains_df.withColumn("steps", all_matches("chain", SPARK.call))
    read = split.withColumns({"ops": F.transform("steps", call_name), "quoted": F.transform("steps", strings)})
    readable = F.forall("steps", lambda s: s.rlike(SPARK.readable_call))
    expressible = F.col("whole") & ~order_problem(F.col("ops"), F.col("quoted")) & readable
    judged = read.withColumn("expressible", expressible)  # a column of its own, or it is computed for each of the next ones
    kept = judged.withColumns({n: F.when(F.col("expressible"), F.col(n)) for n in ("steps", "ops", "quoted")})
    items = kept.withColumns(parts(namespace, base)).withColumn("items", output_items()).withColumn("items", renamed_items())
    return items.select("script_id", "chain_no", sql())


# Of a chain: ``steps`` are the texts of its calls, ``ops`` their names, ``quoted`` their quoted strings.


def _first(of: str, op: str) -> Column:
    """What the first call named ``op`` has in one of those arrays, or NULL."""
    return F.get(of, F.array_position("ops", op).cast("int") - 1)


def _last(of: str, op: str) -> Column:
    return F.get(of, F.size("ops") - F.array_position(F.reverse("ops"), op).cast("int"))


def _each(of: str, ops: list[str], make: Callable[[Column], Column], element: str) -> Column:
    """``make`` of what each call named in ``ops`` has in one of those arrays."""
    found = F.filter(of, lambda _, i: F.get("ops", i).isin(*ops))
    there = reduce(or_, [F.array_contains("ops", op) for op in ops])
    return F.when(there, F.transform(found, make)).otherwise(F.array().cast(f"array<{element}>"))


def quote_if_needed(name: Column) -> Column:
    return F.when(name.rlike(PLAIN_NAME), name).otherwise(_back_ticked(name))


def _back_ticked(name: Column) -> Column:
    return F.concat(F.lit("`"), F.regexp_replace(name, r"\.", "`.`"), F.lit("`"))


def _last_part(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def item(text: Column, natural: Column, name: Column) -> Column:
    """A select item: its text, the name it has by itself, and the name it shall have."""
    return F.struct(text.alias("text"), natural.alias("natural"), name.alias("name"))


def _plain_item(name: Column) -> Column:
    return item(quote_if_needed(name), _last_part(name), _last_part(name))


def _aggregate_item(text: Column) -> Column:
    call = F.concat(
        F.regexp_extract(text, AGGREGATE, 1), F.lit("("), quote_if_needed(F.regexp_extract(text, AGGREGATE, 2)), F.lit(")")
    )
    alias = F.regexp_extract(text, AGGREGATE, 3)
    return item(call, call, F.when(alias == "", call).otherwise(alias))


def _derived_item(step: Column) -> Column:
    expression = F.trim(F.regexp_extract(step, r'"[^"\n]*"\s*,([\s\S]*)\)$', 1))
    for wrapper in (r'^expr\s*\(\s*"([^"\n]*)"\s*\)$', r'\bcol\s*\(\s*"([^"\n]*)"\s*\)', r"\blit\s*\(([^()]*)\)"):
        expression = F.regexp_replace(expression, wrapper, "$1")
    return item(expression, F.lit(None).cast("string"), F.get(strings(step), 0))


def _sort_item(text: Column) -> Column:
    written = F.get(strings(text), 0)
    packed = F.regexp_extract(written, r"^(.*?)(?:\s+(?i:asc|desc))?$", 1)
    direction = F.concat(F.regexp_extract(text, r"^(asc|desc)\s*\(", 1), F.regexp_extract(written, r"\s+((?i:asc|desc))$", 1))
    return F.concat_ws(" ", quote_if_needed(F.trim(packed)), F.nullif(F.upper(direction), F.lit("")))


def table_text(name: Column, namespace: str | None) -> Column:
    return _back_ticked(F.concat(F.lit(f"{namespace}."), name) if namespace else name)


def base_table(base: str | None) -> Column:
    """The table that a chain reads, else the qualifier of its first selected column, else ``base``, else its variable."""
    qualifier = F.nullif(F.regexp_extract(F.get(_first("quoted", "select"), 0), r"^([^.,]*)\.", 1), F.lit(""))
    return F.coalesce(F.get(_first("quoted", "table"), 0), qualifier, F.lit(base), F.col("root"))


def parts(namespace: str | None, base: str | None) -> dict[str, Column]:
    """What each call of a chain contributes, as arrays of texts or items."""
    grouped_at = F.array_position("ops", "groupBy")
    filters = _each("quoted", ["filter", "where"], lambda q: F.trim(F.get(q, 0)), "string")
    ungrouped_ops = F.when(grouped_at > 0, F.slice("ops", 1, F.greatest(grouped_at, F.lit(1)))).otherwise(F.col("ops"))
    before = F.size(F.filter(ungrouped_ops, lambda op: op.isin("filter", "where")))
    early, late = F.slice(filters, 1, before), F.slice(filters, before + 1, F.size(filters))
    counted = item(F.lit("count(*)"), F.lit(None).cast("string"), F.lit("count"))
    aggregates = F.transform(all_matches(_first("steps", "agg"), AGGREGATE), _aggregate_item)
    joins = _each("quoted", ["join"], lambda q: _join(q, namespace), "string")
    limits = _each("steps", ["limit"], lambda s: F.regexp_extract(s, r"(\d+)", 1).try_cast("bigint"), "bigint")
    return {
        "tbl": F.when(F.col("steps").isNotNull(), table_text(base_table(base), namespace)),
        "selected": names(_last("quoted", "select")),
        "select_last": F.array_contains(F.slice("ops", F.greatest(grouped_at, F.lit(1)), F.size("ops")), "select"),
        "keys": names(_first("quoted", "groupBy")),
        "aggregates": F.when(F.array_contains("ops", "count"), F.array(counted)).otherwise(aggregates),
        "derived": _each("steps", ["withColumn"], _derived_item, ITEM),
        "renames": _each("quoted", ["withColumnRenamed"], lambda q: q, "array<string>"),
        "where": F.array_distinct(early),
        "having": F.array_distinct(late),
        "joined": F.array_distinct(joins),
        "sort": F.transform(all_matches(_last("steps", "orderBy"), SORT_KEY), _sort_item),
        "rows": F.array_min(limits),
    }


def _named(items: Column, name: Column) -> Column:
    """The item that has a name, or NULL."""
    return F.get(F.filter(items, lambda i: i["name"] == name), 0)


def output_items() -> Column:
    """Select items of a chain: keys and aggregates, or the selected columns; derived columns join them."""
    grouped = F.concat(F.transform("keys", _plain_item), F.col("aggregates"))
    picked = F.transform("selected", lambda n: F.coalesce(_named(grouped, n), _plain_item(n)))
    plain = F.transform(F.coalesce("selected", F.array(F.lit("*"))), _plain_item)
    listed = F.when(F.col("keys").isNull(), plain).when(F.col("select_last"), picked).otherwise(grouped)
    replaced = F.transform(listed, lambda i: F.coalesce(_named(F.col("derived"), i["name"]), i))
    return F.concat(replaced, F.filter("derived", lambda d: ~F.exists(listed, lambda i: i["name"] == d["name"])))


def _join(parts: Column, namespace: str | None) -> Column:
    return F.concat(
        join_keyword(F.get(parts, 2)), F.lit(" JOIN "), table_text(F.get(parts, 0), namespace), F.lit(" ON "), F.get(parts, 1)
    )


def renamed_items() -> Column:
    """A rename replaces the name of the item that has it, also inside ``*``; else it changes nothing."""

    def rename(items: Column, pair: Column) -> Column:
        old, new = F.get(pair, 0), F.get(pair, 1)
        in_star = F.exists(items, lambda i: i["name"] == "*") & ~F.exists(items, lambda i: i["name"] == old)
        listed = F.transform(items, lambda i: F.when(i["name"] == old, item(i["text"], i["natural"], new)).otherwise(i))
        cut = F.transform(items, lambda i: F.when(i["name"] == "*", item(without(i["text"], old), F.lit("*"), F.lit("*"))).otherwise(i))
        return F.when(in_star, F.concat(cut, F.array(item(quote_if_needed(old), old, new)))).otherwise(listed)

    return F.when(F.size("renames") > 0, F.aggregate("renames", F.col("items"), rename)).otherwise(F.col("items"))


def without(star: Column, name: Column) -> Column:
    """``*`` or ``* EXCEPT (...)`` with one more column left out."""
    more = F.concat(F.regexp_replace(star, r"\)$", ", "), quote_if_needed(name), F.lit(")"))
    return F.when(star == "*", F.concat(F.lit("* EXCEPT ("), quote_if_needed(name), F.lit(")"))).otherwise(more)


def _all_of(predicates: Column) -> Column:
    alone = F.get(predicates, 0)
    together = F.array_join(F.transform(predicates, lambda p: F.concat(F.lit("("), p, F.lit(")"))), " AND ")
    return F.when(F.size(predicates) == 1, alone).when(F.size(predicates) > 1, together)


def _clause(keyword: str, text: Column) -> Column:
    return F.concat(F.lit(f"{keyword} "), text)


def _listed(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.array_join(array, ", "))


def sql() -> Column:
    items = F.transform(
        "items",
        lambda i: F.when(i["natural"].eqNullSafe(i["name"]), i["text"]).otherwise(
            F.concat(i["text"], F.lit(" AS "), quote_if_needed(i["name"]))
        ),
    )
    head = F.when(F.array_contains("ops", "distinct"), "SELECT DISTINCT").otherwise("SELECT")
    text = F.concat_ws(
        " ",
        head,
        F.array_join(items, ", "),
        _clause("FROM", F.col("tbl")),
        F.col("joined"),
        _clause("WHERE", _all_of(F.col("where"))),
        _clause("GROUP BY", _listed(F.transform("keys", quote_if_needed))),
        _clause("HAVING", _all_of(F.col("having"))),
        _clause("ORDER BY", _listed(F.col("sort"))),
        _clause("LIMIT", F.col("rows").cast("string")),
    )
    return F.when(F.col("steps").isNotNull(), text).alias("sql_text")
