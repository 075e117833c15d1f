"""Aggregates over joins, combined below the join.

``sum``, ``count``, ``avg``, ``min`` and ``max`` of one table's columns over a join need not see each row of that
table: rows that agree in all columns that the joins, predicates and keys read are joined with the same rows. So
the table is first grouped by those columns, and the join moves one row of partial values for each group. The
final aggregates add the partial values up. This holds for every join type: where the table has no match, its
partial values are NULL, which stands for the one row without values that an outer join makes.

Values and types are those of the plain block, but for sums of doubles, whose last bits may differ with the order
of additions. Distinct or filtered aggregates, averages of decimals (whose rounding would differ) and aggregates
that read other tables are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"`[^`]+`|[A-Za-z_]\w*")
_PART = "_blockquery_part"

COMBINED = {
    "Sum": lambda parts: f"sum({parts[0]})",
    "Min": lambda parts: f"min({parts[0]})",
    "Max": lambda parts: f"max({parts[0]})",
    "Count": lambda parts: f"coalesce(sum(coalesce({parts[0]}, 0)), 0)",
    "CountRows": lambda parts: f"coalesce(sum(coalesce({parts[0]}, 1)), 0)",
    "Average": lambda parts: f"(sum({parts[0]}) / sum({parts[1]}))",
}
"""How partial values become the aggregate, by kind. A row without partial values counts as one row."""


@dataclass(frozen=True)
class Partial:
    """The partial aggregates of one table, and the texts that make the block's aggregates of them."""

    before: dict[str, tuple[str, Column]]
    """The function and its value, by name."""
    after: dict[str, Column]


def partial_aggregates(grouped: DataFrame, names: Sequence[str], table: DataFrame) -> Partial:
    """Split the aggregates ``names`` of the plain block ``grouped`` into partial ones of ``table`` and final ones.

    The aggregates are read from Spark's analysis of the block, so any spelling and any expression around them will do.
    """
    types = dict(grouped.dtypes)
    found = grouped._jdf.queryExecution().analyzed().aggregateExpressions()
    of_name = {}
    for i in range(found.size() - len(names), found.size()):
        of_name[found.apply(i).name()] = found.apply(i).child()
    before, after, known = {}, {}, {}

    def parts(call) -> str:
        text = call.sql()
        if text not in known:
            kind, partial = _partial(call, text, table)
            columns = [f"{_PART}_{len(before) + i}" for i in range(len(partial))]
            before.update(zip(columns, partial, strict=True))
            known[text] = COMBINED[kind](columns)
        return known[text]

    for name in names:
        text = of_name[name].sql()
        for call in sorted(_calls(of_name[name]), key=lambda c: -len(c.sql())):
            text = text.replace(call.sql(), parts(call))
        after[name] = F.expr(text).cast(types[name])
    return Partial(before, after)


def _calls(expression) -> list:
    """The aggregate calls in an analysed expression."""
    if expression.getClass().getSimpleName() == "AggregateExpression":
        return [expression]
    children = expression.children()
    return [call for i in range(children.size()) for call in _calls(children.apply(i))]


def _partial(call, text: str, table: DataFrame) -> tuple[str, list[tuple[str, Column]]]:
    """The kind of an aggregate call and its partial aggregates over ``table``, as functions and values."""
    function = call.aggregateFunction()
    kind = function.getClass().getSimpleName()
    arguments = function.children()
    if kind not in COMBINED or call.isDistinct() or call.filter().isDefined() or arguments.size() != 1:
        raise ValueError(f"{text} cannot be combined below a join")
    argument = arguments.apply(0)
    value = F.expr(argument.sql())
    if argument.references().isEmpty():
        if kind != "Count" or argument.nullable():
            raise ValueError(f"{text} reads no column, so it cannot be combined below a join")
        return "CountRows", [("count", F.lit(1))]
    if not reads_only(table, argument.sql()):
        raise ValueError(f"{text} reads other tables than the one that is combined below the join")
    if kind != "Average":
        return kind, [(kind.lower(), value)]
    if argument.dataType().typeName().startswith("decimal"):
        raise ValueError(f"{text} is an average of decimals, whose rounding would differ below a join")
    return kind, [("sum", value.cast("double")), ("count", value)]


def reads_only(table: DataFrame, text: str) -> bool:
    """Whether an expression can be resolved with the columns of ``table`` alone."""
    try:
        table.select(F.expr(text))
    except AnalysisException:
        return False
    return True


def combined(table: DataFrame, alias: str, texts: Iterable[str], partial: Partial, where: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``table`` after ``where``, grouped by all its columns whose names occur in ``texts``, with the partial aggregates.

    A name that occurs for another reason only makes finer groups.
    """
    read = {w.strip("`").lower() for text in texts for w in _WORD.findall(text)}
    kept = [F.col(f"`{c}`") for c in table.columns if c.lower() in read]
    return where(table).groupBy(*kept).agg(*[getattr(F, fn)(value).alias(n) for n, (fn, value) in partial.before.items()]).alias(alias)
