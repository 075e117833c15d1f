"""Joins on condition text.

Spark picks the algorithm: a side is broadcast only when its known size is below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits hot keys of inner joins and of
the preserved side of outer joins. What it cannot split is written differently here:

* semi and anti joins: the right side is first reduced to the distinct values the condition reads, so a
  hot key there shrinks to one row before the shuffle;
* left, right and full joins whose other side is too large to be broadcast: matched rows come from an inner
  join, of which both sides are split, and unmatched ones from an anti join against distinct values.

The second form reads its inputs twice. In a chain of such joins the result so far is written once to shared
storage, so scans grow by a constant per join.

Whether a condition has an equality over both sides is what Spark finds in the analysed join. Without one, Spark
compares all rows with all rows. A condition that bounds one side by the other from above and from below goes to ``range_join``
instead, unless a side is tiny; any other is accepted only if a side that Spark can broadcast is known to be small.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.functions.names import join_type
from blockquery.operators.ranges import Reach, range_join
from blockquery.sources.checkpoints import reliable

_NAME = re.compile(
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|((?:(?:`[^`]+`|[A-Za-z_]\w*)\s*\.\s*)*)(`[^`]+`|[A-Za-z_]\w*)(?!\s*\()"""
)  # texts in quotes (no group), or a name (group 2) with its qualifiers (group 1)
_SPLIT = "_blockquery_split"

TINY = 10_000
"""Bytes of a side with which all rows of the other are compared although the condition is a range."""

Aliases = tuple[Sequence[str], Sequence[str]]


@dataclass(frozen=True)
class Join:
    """One join of a block. ``hot_right`` asks for the form that splits a hot right side whatever its size."""

    table: str
    condition: str
    how: str = "inner"
    hot_right: bool = False


def unique_joins(joins: Iterable[Join]) -> list[Join]:
    """Repeats of the same table, condition and type collapse to the first."""
    first: dict[tuple, Join] = {}
    for j in joins:
        first.setdefault((j.table, j.condition, join_type(j.how)), j)
    return list(first.values())


def join_on(
    left: DataFrame,
    right: DataFrame,
    condition: str,
    how: str = "inner",
    hot_right: bool = False,
    aliases: Aliases | None = None,
) -> DataFrame:
    """Join two aliased DataFrames on condition text. ``aliases`` are the names that qualify columns of either side."""
    how = join_type(how)
    on = F.expr(condition)
    equality, reaches = _judged(left, right, on)
    if not equality and not _may_broadcast(left, right, how, None if reaches is None else TINY):
        if reaches is None:
            raise ValueError(
                f"the condition {condition!r} of a {how} join has no equality, and no side that could be broadcast is known "
                "to be below spark.sql.autoBroadcastJoinThreshold: add an equality, or bound one side by the other from above and from below"
            )
        return range_join(left, right, on, *reaches, "inner" if how == "cross" else how)
    of_left, of_right = aliases or (None, None)
    if how == "cross":  # a condition is always present, so this is an inner join to the optimizer
        return left.crossJoin(right).filter(on)
    if how in ("left_semi", "left_anti"):
        return left.join(_values_read(right, condition, of_right), on, how)
    small = {"left": is_small(right) and not hot_right, "right": is_small(left)}
    if how == "inner" or small.get(how, False) or not equality:
        return left.join(right, on, how)
    if getattr(left, _SPLIT, False):
        left = reliable(left)
    parts = [left.join(right, on, "inner")]
    if how in ("left", "full"):
        rest = left.join(_values_read(right, condition, of_right), on, "left_anti")
        parts.append(rest.select("*", *_nulls(right)))
    if how in ("right", "full"):
        rest = right.join(_values_read(left, condition, of_left), on, "left_anti")
        parts.append(rest.select(*_nulls(left), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    setattr(out, _SPLIT, True)
    return out


def _judged(left: DataFrame, right: DataFrame, on: Column) -> tuple[bool, tuple[Reach, Reach] | None]:
    """Whether the analysed join has an equality over both sides, and the reaches of its sides if it is a range."""
    node = left.join(right, on, "inner")._jdf.queryExecution().analyzed()
    keys = left.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    if keys.unapply(node).isDefined():
        return True, None
    below = above = None  # (expression of the left side, of the right side) where left <= right, and where left >= right
    for low, high in _rising(node.condition().get()):
        sides = _side_of(low, node), _side_of(high, node)
        if sides == ("l", "r"):
            below = below or (low.sql(), high.sql())
        elif sides == ("r", "l"):
            above = above or (high.sql(), low.sql())
    if below is None or above is None:
        return False, None
    return False, (Reach(below[0], above[0]), Reach(below[1], above[1]))


def _rising(expression) -> list[tuple]:
    """Pairs of expressions of which the first is not above the second, of all ANDed parts that say so."""
    kind = expression.getClass().getSimpleName()
    if kind == "And":
        return _rising(expression.left()) + _rising(expression.right())
    if kind == "Between":
        value, lower, upper = map(expression.parameters().apply, range(3))
        return [(lower, value), (value, upper)]
    if kind in ("LessThan", "LessThanOrEqual"):
        return [(expression.left(), expression.right())]
    if kind in ("GreaterThan", "GreaterThanOrEqual"):
        return [(expression.right(), expression.left())]
    return []


def _side_of(expression, node) -> str | None:
    """The side that an expression reads, if it reads one and only that."""
    read = expression.references()
    if read.isEmpty() or not expression.deterministic():
        return None
    return next((s for s, child in (("l", node.left()), ("r", node.right())) if read.subsetOf(child.outputSet())), None)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether Spark knows the size of a plan to be within its broadcast threshold, and within ``limit`` bytes."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= (threshold if limit is None else min(threshold, limit))


def _may_broadcast(left: DataFrame, right: DataFrame, how: str, limit: int | None) -> bool:
    """Whether a side that Spark could broadcast is known to be within its threshold, and within ``limit`` bytes."""
    sides = {"left": [right], "left_semi": [right], "left_anti": [right], "right": [left], "full": []}.get(how, [left, right])
    return any(is_small(side, limit) for side in sides)


def _values_read(df: DataFrame, condition: str, aliases: Sequence[str] | None) -> DataFrame:
    """The distinct values of this side's columns that a condition reads; all of ``df`` if names are ambiguous."""
    own = None if aliases is None else {a.lower() for a in aliases}
    read = set()
    for match in _NAME.finditer(condition):
        if match[2]:
            qualifier = match[1].rstrip(". \t\n").rsplit(".", 1)[-1].strip("` ").lower()
            if not qualifier or own is None or qualifier in own:
                read.add(match[2].strip("`").lower())
    names = [c for c in df.columns if c.lower() in read]
    if not names or len({c.lower() for c in names}) < len(names):
        return df
    return df.select(*[F.col(f"`{c}`") for c in names]).distinct()


def _nulls(df: DataFrame) -> list:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
