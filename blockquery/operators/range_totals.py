"""Grouped aggregates over a range join, taken without making its pairs.

A range join of two large sides has about as many pairs as the product of their rows, cut by the share of the range,
so aggregates over them cannot wait for the pairs. They need not: in points that lie in spans, with at most one more
comparison between the sides, each row of one side meets a run of the rows of the other.

The distinct points are numbered in order, and a span reaches from one number to another. Numbers are gathered in nodes:
one, 4, 16 and so on, as far as spans need them. A point goes to the node of each size that holds it, a span
to the few nodes that fill it exactly, so a point in a span shares one node with it and any other point none. In a node all
points lie in all spans, and the comparison that is left asks for the rows up to a value: the aggregates are
running ones in the order of that value, and the rows of the other side read them off. The work grows with the rows, times
a logarithm for long spans, whatever the number of pairs. Rows of a node that many share are cut into chunks that carry their
totals (``operators/windows.py``).

Sums, counts, averages (not of decimals), minima and maxima of one side are taken so (``operators/early.py``); their
values and types are those of the plain block, but for sums of doubles, whose last bits may differ with the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DateType, NumericType, TimestampNTZType, TimestampType

from blockquery.functions.names import join_type, split_names
from blockquery.operators import joins, windows
from blockquery.operators.clauses import Expressions, group_aggregate
from blockquery.operators.early import Partial, partial_aggregates, reads_only
from blockquery.sources.checkpoints import written

FAN = 4
"""Nodes of one size that make one of the next."""

ROWS = 1_000_000
"""Rows that are read off without a look at how many pairs there are."""

PAIRS = 16
"""Pairs that can be compared in the time that one row takes here."""

LEVELS = 64
"""More than there can be sizes: a node is its place times this, plus its size."""


@dataclass(frozen=True)
class Bound:
    """``low <= high`` or ``low < high`` between expressions of different sides."""

    low_side: str
    low: str
    high_side: str
    high: str
    strict: bool

    def of(self, side: str) -> str:
        return self.low if side == self.low_side else self.high


@dataclass(frozen=True)
class Shape:
    """A condition taken apart: points of one side, their two bounds, one more bound or none, and what reads one side only."""

    points: str
    low: Bound
    high: Bound
    more: Bound | None
    own: dict[str, list[str]]


def join_totals(
    left: DataFrame,
    right: DataFrame,
    join: joins.Join,
    where: str | Iterable[str],
    keys: str | Iterable[str | Column],
    aggs: Expressions,
    hot_rows: int | None = None,
) -> DataFrame | None:
    """The grouped block over an inner range join of two large aliased sides, or nothing where it has another form."""
    how = join_type(join.how)
    if how not in ("inner", "cross") or not aggs:
        return None
    equality, reaches = joins._judged(left, right, F.expr(join.condition))
    if equality or reaches is None or joins._may_broadcast(left, right, how, joins.TINY):
        return None
    predicates = [join.condition, *([where] if isinstance(where, str) else where)]
    plain = left.join(right, reduce(and_, map(F.expr, predicates)), "inner")
    node = plain._jdf.queryExecution().analyzed()
    grouped = group_aggregate(plain, split_names(keys), aggs)
    shape, keyed = _shape(node), _keys(node, grouped)
    if shape is None or keyed is None or not _alone(grouped, len(aggs)):
        return None
    sides = {"l": left, "r": right}
    for side in "lr":
        try:
            partial = partial_aggregates(grouped, list(aggs), sides[side])
        except ValueError:
            continue
        texts = _texts(shape, keyed)
        if not all(reads_only(sides[s], t) for s in "lr" for t in [*texts[s].values(), *shape.own[s]]):
            return None
        if not all(_ordered(sides[s], t) for s in "lr" for n, t in texts[s].items() if n not in keyed[s]):
            return None
        totals = _totals(sides, shape, keyed, texts, partial, side, hot_rows or windows.HOT_ROWS)
        if totals is None:
            continue
        named = [F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(totals.columns, grouped.schema.fields, strict=True)]
        # no row of the plain block is made: it only gives the columns their qualifiers, for later clauses
        return grouped.filter(F.lit(False)).union(totals.select(*named))
    return None


def _conjuncts(expression) -> list[tuple]:
    """The ANDed parts of a condition: ``(low, high, strict)`` for a comparison, else one expression."""
    kind = expression.getClass().getSimpleName()
    if kind == "And":
        return _conjuncts(expression.left()) + _conjuncts(expression.right())
    if kind == "Between":
        value, lower, upper = map(expression.parameters().apply, range(3))
        if _alike(value, lower) and _alike(value, upper):
            return [(lower, value, False), (value, upper, False)]
    if kind in ("LessThan", "LessThanOrEqual") and _alike(expression.left(), expression.right()):
        return [(expression.left(), expression.right(), kind == "LessThan")]
    if kind in ("GreaterThan", "GreaterThanOrEqual") and _alike(expression.left(), expression.right()):
        return [(expression.right(), expression.left(), kind == "GreaterThan")]
    return [(expression,)]


def _alike(one, other) -> bool:
    return one.dataType().json() == other.dataType().json()


def _read(expression, node) -> str:
    """The sides that an expression reads; all of them if its value is not always the same."""
    if not expression.deterministic():
        return "lr"
    return "".join(s for s, child in (("l", node.left()), ("r", node.right())) if not expression.references().intersect(child.outputSet()).isEmpty())


def _shape(node) -> Shape | None:
    bounds, own = [], {"l": [], "r": []}
    for part in _conjuncts(node.condition().get()):
        low, high = _read(part[0], node), _read(part[-2 if len(part) > 1 else 0], node)
        both = set(low + high)
        if len(both) == 1:
            texts = [e.sql() for e in part[:2]]
            own[both.pop()].append(texts[0] if len(part) == 1 else f"({texts[0]}) {'<' if part[2] else '<='} ({texts[1]})")
        elif len(part) > 1 and len(low) == len(high) == 1:
            bounds.append(Bound(low, part[0].sql(), high, part[1].sql(), part[2]))
        else:
            return None
    if len(bounds) > 3:
        return None
    for low in bounds:
        for high in bounds:
            if (low.high_side, low.high) == (high.low_side, high.low):
                rest = [b for b in bounds if b is not low and b is not high]
                return Shape(low.high_side, low, high, rest[0], own) if rest else Shape(low.high_side, low, high, None, own)
    return None


def _keys(node, grouped: DataFrame) -> dict[str, dict[str, str]] | None:
    """The keys that each side gives, by names of their own, or nothing if one reads both sides or none."""
    found = grouped._jdf.queryExecution().analyzed().groupingExpressions()
    out = {"l": {}, "r": {}}
    for i in range(found.size()):
        side = _read(found.apply(i), node)
        if len(side) != 1 or not isinstance(grouped.schema[i].dataType, AtomicType):
            return None
        out[side][f"_key{i}"] = found.apply(i).sql()
    return out


def _alone(grouped: DataFrame, aggs: int) -> bool:
    """Whether the aggregates read columns in their calls only, and have values that are always the same."""
    found = grouped._jdf.queryExecution().analyzed().aggregateExpressions()

    def closed(expression) -> bool:
        if expression.getClass().getSimpleName() == "AggregateExpression":
            return True
        children = expression.children()
        return expression.getClass().getSimpleName() != "AttributeReference" and all(closed(children.apply(i)) for i in range(children.size()))

    return all(found.apply(i).deterministic() and closed(found.apply(i).child()) for i in range(found.size() - aggs, found.size()))


def _texts(shape: Shape, keyed: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """What each side is asked for, by the names it gets."""
    spans = _other(shape.points)
    texts = {shape.points: {"_x": shape.low.high}, spans: {"_low": shape.low.low, "_high": shape.high.high}}
    return {s: {**texts[s], **({"_value": shape.more.of(s)} if shape.more else {}), **keyed[s]} for s in "lr"}


def _other(side: str) -> str:
    return "r" if side == "l" else "l"


def _ordered(df: DataFrame, text: str) -> bool:
    return isinstance(df.select(F.expr(text).alias("v")).schema["v"].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))


def _totals(
    sides: dict[str, DataFrame],
    shape: Shape,
    keyed: dict[str, dict[str, str]],
    texts: dict[str, dict[str, str]],
    partial: Partial,
    side: str,
    hot_rows: int,
) -> DataFrame | None:
    """The keys, as they are numbered, and the aggregates of the side ``side``, which the rows of the other side read off.

    A row reads off once for each value of the keys of ``side`` in its node. Nothing comes back where these are so many that
    the pairs are less work.
    """
    other, spans = _other(side), _other(shape.points)
    parts = {n: (fn, f"_of{n}") for n, (fn, _) in partial.before.items()}
    rows = {}
    for s in "lr":
        given = {n: F.expr(t) for n, t in texts[s].items()}
        compared = [F.col(n).isNotNull() for n in given if n not in keyed[s]]
        if s == side:
            given |= {f"_of{n}": value for n, (_, value) in partial.before.items()}
        own = reduce(DataFrame.filter, shape.own[s], sides[s])
        rows[s] = own.select(*[c.alias(n) for n, c in given.items()]).filter(reduce(and_, compared))
    own_keys = list(keyed[side])
    counts = {s: written(rows[s].groupBy(*_ends(rows[s]), *(own_keys if s == side else [])).agg(F.count("*").alias("_rows"))) for s in "lr"}
    places = _places(counts[shape.points], counts[spans])
    levels = _levels(_placed(counts[spans], shape, places))
    nodes = {s: _in_nodes(_placed(rows[s], shape, places), s == spans, levels) for s in "lr"}
    sizes = {s: _in_nodes(_placed(counts[s], shape, places), s == spans, levels) for s in "lr"}
    by = [f"_key{i}" for i in range(sum(map(len, keyed.values())))]
    after = [c.alias(n) for n, c in partial.after.items()]
    if shape.more is None:
        totals = nodes[side].groupBy("_node", *own_keys).agg(*[getattr(F, fn)(c).alias(n) for n, (fn, c) in parts.items()])
        return nodes[other].join(totals, "_node").groupBy(*by).agg(*after)
    there = sizes[other].groupBy("_node").agg(F.sum("_rows").alias("_there"))
    here = sizes[side].groupBy("_node", *own_keys).agg(F.sum("_rows").alias("_here"))
    groups = written(here.join(there, "_node").withColumn("_rows", F.col("_here") + F.col("_there")))
    if _pairs_are_fewer(groups):
        return None
    given = nodes[side].join(groups.select("_node").distinct(), "_node", "left_semi").withColumns({"_tie": F.lit(int(shape.more.strict)), "_met": F.lit(1)})
    asked = nodes[other].join(groups.select("_node", *own_keys), "_node").withColumn("_tie", F.lit(int(not shape.more.strict)))
    both = given.unionByName(asked, allowMissingColumns=True)
    order = ["_value" if side == shape.more.low_side else "_value DESC", "_tie"]
    if not groups.filter(F.col("_rows") > hot_rows).isEmpty():
        both = both.withColumn("_any", F.monotonically_increasing_id())  # so rows of one value can be cut into chunks
        order.append("_any")
    upto = windows.running(both, ["_node", *own_keys], order, {**parts, "_pairs": ("count", "_met")}, hot_rows, groups.select("_node", *own_keys, "_rows"))
    return upto.filter("_met IS NULL AND _pairs > 0").groupBy(*by).agg(*after)


def _pairs_are_fewer(groups: DataFrame) -> bool:
    rows, pairs = groups.agg(F.sum("_rows"), F.sum(F.col("_here").cast("double") * F.col("_there"))).first()
    return (rows or 0) > max(ROWS, (pairs or 0) / PAIRS)


def _ends(df: DataFrame) -> list[str]:
    return [c for c in ("_x", "_low", "_high") if c in df.columns]


def _places(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Every end of a span and every point, with the number of distinct points that are not above it, and whether it is one itself."""
    ends = [points.select(F.col("_x").alias("_at"), F.lit(1).alias("_point"))]
    ends += [spans.select(F.col(c).alias("_at"), F.lit(0).alias("_point")) for c in ("_low", "_high")]
    values = reduce(DataFrame.union, ends).groupBy("_at").agg(F.max("_point").alias("_point"))
    return written(windows.running(values, [], ["_at"], {"_upto": ("sum", "_point")}))


def _placed(df: DataFrame, shape: Shape, places: DataFrame) -> DataFrame:
    """Points with their number, spans with the first number they hold and the one after the last."""
    upto, below = F.col("_upto"), F.col("_upto") - F.col("_point")
    asked = {
        "_x": {"_first": upto - 1},
        "_low": {"_first": upto if shape.low.strict else below},
        "_high": {"_end": below if shape.high.strict else upto},
    }
    for end in _ends(df):
        found = places.select(F.col("_at"), *[c.alias(n) for n, c in asked[end].items()])
        df = df.join(found, F.col(end) == F.col("_at"), "inner").drop("_at", end)
    return df


def _levels(spans: DataFrame) -> int:
    """How many sizes of nodes the longest span needs."""
    longest = spans.agg(F.max(F.col("_end") - F.col("_first"))).first()[0] or 1
    return next(k for k in range(1, LEVELS) if FAN**k > longest)


def _in_nodes(df: DataFrame, spans: bool, levels: int) -> DataFrame:
    """Each row once for every node it belongs to."""
    if not spans:
        at = F.explode(F.array(*[F.expr(f"(_first div {FAN**k}L) * {LEVELS} + {k}") for k in range(levels)]))
        return df.withColumn("_node", at).drop("_first")
    pieces = []
    for k in range(levels):
        first, end = f"((_first + {FAN**k - 1}L) div {FAN**k}L)", f"(_end div {FAN**k}L)"
        inner_first, inner_end = f"((_first + {FAN ** (k + 1) - 1}L) div {FAN ** (k + 1)}L * {FAN})", f"(_end div {FAN ** (k + 1)}L * {FAN})"
        split = f"least({inner_first}, {end})"
        for start, stop in ((first, split), (f"greatest({inner_end}, {split})", end)):
            pieces.append(f"IF({start} < {stop}, transform(sequence({start}, {stop} - 1), n -> n * {LEVELS} + {k}), array())")
    return df.withColumn("_node", F.explode(F.expr(f"concat({', '.join(pieces)})"))).drop("_first", "_end")
