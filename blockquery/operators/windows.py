"""Window columns whose partitions may be huge.

Spark sorts each window partition in one task. A key that holds a third of all rows would make that task
as large as a third of the table, so keys above ``hot_rows`` rows take another way; all other rows keep
Spark's own window. Both ways give the same values, and no row is dropped.

The other way cuts the rows of the hot keys into ordered chunks: they are range-partitioned by key and
order columns and checkpointed once, and each partition is a chunk. A running value is the value within
the chunk plus what the earlier chunks add up to, which is a window over one row per key and chunk.
Windows that look at a bounded number of neighbours run on blocks of consecutive positions, with the
neighbouring rows copied into the block.

``keys`` may be empty: the table is then one key. Order columns should identify a row within its key; among ties the order is free, as in any window. Both ways
have the same types and the same values, but for running sums of doubles, whose last bits may differ with the
order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce, wraps
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from blockquery.functions.names import reversed_sort, sort_column, sort_name
from blockquery.operators.clauses import row_hash
from blockquery.sources.checkpoints import reliable

HOT_ROWS = 2_000_000
"""Rows of one key that a single task may sort, unless a call says otherwise."""

SPREAD = 128
"""Parts of one key that are cut to their first rows separately."""

ALL = "_blockquery_all"
"""The key of windows without keys: a column with one value."""

_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
TOTAL = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _keyed(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``function`` also for no keys at all: the whole table is then one key, cut like any other hot one."""

    @wraps(function)
    def run(df: DataFrame, keys: Sequence[str], *args, **options) -> DataFrame:
        if keys:
            return function(df, keys, *args, **options)
        return function(df.withColumn(ALL, F.lit(0)), [ALL], *args, **options).drop(ALL)

    return run


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    Rows of a key are spread by a hash of the whole row, also where they tie, and each part is cut to ``n`` first, so a hot key is sorted by many tasks
    and its last one gets at most ``SPREAD`` times ``n`` rows.
    """
    sorts = [sort_column(o) for o in order]
    parts = df.withColumn("_part", F.pmod(row_hash(df), F.lit(SPREAD)))
    for by in ([*keys, "_part"], keys):
        parts = parts.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*sorts))).filter(F.col("_n") <= n).drop("_n")
    return parts.drop("_part")


@_keyed
def partition_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Aggregates of the whole partition beside each row: grouped first, then joined back on the key.

    Grouping shrinks hot keys on the map side; the join back is a broadcast when the grouped side is
    small enough for Spark, else a join that adaptive execution splits on hot keys.
    """
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return attach(df, grouped, keys)


@_keyed
def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: Mapping[str, str], last: Mapping[str, str]) -> DataFrame:
    """Values of the first and last row of each key, as ``{output: column}``.

    Ascending columns: two aggregates. With a direction in an order text: the first row by the order and the
    first one by its opposite.
    """
    if all(sort_name(o) == o.strip("` ") for o in order):
        position = F.struct(*order)
        ends = {n: F.min_by(c, position) for n, c in first.items()} | {n: F.max_by(c, position) for n, c in last.items()}
        return partition_totals(df, keys, ends)
    for ends, sorts in ((first, list(map(sort_column, order))), (last, list(map(reversed_sort, order)))):
        if ends:
            source = df.select(*keys, *{c: None for o in order if (c := sort_name(o)) not in keys}, *[F.col(c).alias(n) for n, c in ends.items()])
            at = source.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*sorts)))
            df = attach(df, at.filter(F.col("_n") == 1).select(*keys, *ends), keys)
    return df


@_keyed
def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, tuple[str, str | Column]],
    hot_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Aggregates from the first row of the key to the current one.

    ``columns`` maps an output name to ``(function, value)`` with sum, count, min or max. ``counts`` are the rows of each
    key as ``_rows``, where they are known.
    """
    cold, hot = split_hot(df, keys, hot_rows, counts)
    return _both(cold, hot, lambda part: _running(part, keys, order, columns), lambda h: _running_chunked(h, keys, order, columns))


@_keyed
def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot_rows: int | None = None) -> DataFrame:
    """Position of each row within its key, from 1."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, hot_rows)


@_keyed
def ranks(
    df: DataFrame,
    keys: Sequence[str],
    by: str | Sequence[str],
    rank: str,
    dense_rank: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """``rank`` and ``dense_rank`` of each row by one or more order texts, in either direction.

    Rows are counted per key and values first, so ties cost nothing; the running count of those rows
    gives both ranks, which are then joined back.
    """
    order = [by] if isinstance(by, str) else list(by)
    values = [sort_name(o) for o in order]
    counts = df.groupBy(*keys, *values).agg(F.count("*").alias("_rows"))
    upto = running(counts, keys, order, {"_upto": ("sum", "_rows"), dense_rank: ("count", F.lit(1))}, hot_rows)
    placed = upto.select(*keys, *values, (F.col("_upto") - F.col("_rows") + 1).alias(rank), dense_rank)
    return attach(df, placed, [*keys, *values])


@_keyed
def ntiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int, name: str, hot_rows: int | None = None) -> DataFrame:
    """Number of the tile of each row when a key is cut into ``tiles`` parts as equal as possible."""

    def cold_way(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.ntile(tiles).over(_window(keys, order)).cast("long"))

    def hot_way(hot: Hot) -> DataFrame:
        placed = _running_chunked(hot, keys, order, {"_n": ("count", F.lit(1))})
        sized = attach(placed, hot.counts.withColumnRenamed("_rows", "_size"), keys)
        small, large = F.expr(f"_size div {tiles}"), F.expr(f"_size % {tiles}")
        before, n = large * (small + 1), F.col("_n") - 1
        tile = F.when(n < before, F.floor(n / (small + 1)) + 1).otherwise(large + F.floor((n - before) / small) + 1)
        return sized.withColumn(name, tile.cast("long")).drop("_n", "_size")

    return _both(*split_hot(df, keys, hot_rows), cold_way, hot_way)


@_keyed
def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Windows that read at most ``before`` rows back and ``after`` rows ahead: lag, lead, moving frames.

    Each column is a function of the ordered window, for example ``lambda w: F.lag("v").over(w)``.
    """

    def cold_way(part: DataFrame) -> DataFrame:
        return part.withColumns({n: c(_window(keys, order)) for n, c in columns.items()})

    def hot_way(hot: Hot) -> DataFrame:
        placed = _running_chunked(hot, keys, order, {"_n": ("count", F.lit(1))})
        size = hot.hot_rows
        reach = F.sequence(F.expr(f"greatest(_n - 1 - {after}, 0) div {size}"), F.expr(f"(_n - 1 + {before}) div {size}"))
        copies = placed.withColumn("_own", F.expr(f"(_n - 1) div {size}")).withColumn("_block", F.explode(reach))
        window = W.partitionBy(*keys, "_block").orderBy("_n")
        out = copies.withColumns({n: c(window) for n, c in columns.items()})
        return out.filter(F.col("_block") == F.col("_own")).drop("_n", "_own", "_block")

    return _both(*split_hot(df, keys, hot_rows), cold_way, hot_way)


class Hot:
    """The rows of the hot keys, cut into ordered chunks on demand."""

    def __init__(self, rows: DataFrame, counts: DataFrame, keys: Sequence[str], counted: int, total: int, hot_rows: int):
        self.rows, self.counts, self.keys = rows, counts, keys
        self.counted, self.hot_rows = counted, hot_rows
        self.chunks = -(-total // hot_rows) * 2

    def chunked(self, order: Sequence[str]) -> DataFrame:
        ranged = self.rows.repartitionByRange(self.chunks, *self.keys, *map(sort_column, order))
        return reliable(ranged.withColumn("_chunk", F.spark_partition_id()))


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None, counts: DataFrame | None = None) -> tuple[DataFrame, Hot | None]:
    """Rows of ordinary keys, and those of keys with more than ``hot_rows`` rows (if there are any).

    One counting pass over the key columns finds them, as soon as this is called, unless ``counts`` are given. There are fewer hot keys
    than ``rows / hot_rows``, and Spark broadcasts them if they are small enough.
    """
    hot_rows = hot_rows or HOT_ROWS
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")) if counts is None else counts
    counts = counts.filter(F.col("_rows") > hot_rows)
    counted, total = counts.agg(F.count("*"), F.sum("_rows")).first()
    if not counted:
        return df, None
    counts = reliable(counts)
    if list(keys) == [ALL]:
        return df.filter(F.lit(False)), Hot(df, counts, keys, counted, total, hot_rows)
    other = _renamed(counts.select(*keys), keys)
    cold = df.join(other, _same(keys), "left_anti")
    return cold, Hot(df.join(other, _same(keys), "left_semi"), counts, keys, counted, total, hot_rows)


def _both(cold: DataFrame, hot: Hot | None, cold_way: Callable, hot_way: Callable) -> DataFrame:
    out = cold_way(cold)
    if hot is None:
        return out
    # the types are those of the ordinary way, whether there is a hot key or not
    return out.unionByName(hot_way(hot).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in out.schema.fields]))


def _window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*map(sort_column, order))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping) -> DataFrame:
    window = _window(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({n: getattr(F, fn)(value).over(window) for n, (fn, value) in columns.items()})


def _running_chunked(hot: Hot, keys: Sequence[str], order: Sequence[str], columns: Mapping) -> DataFrame:
    rows, parts = hot.chunked(order), [*keys, "_chunk"]
    within = _running(rows, parts, order, columns)
    sums = rows.groupBy(*parts).agg(*[getattr(F, fn)(value).alias(f"_{n}") for n, (fn, value) in columns.items()])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*parts, *[TOTAL[fn](f"_{n}").over(earlier).alias(f"_before_{n}") for n, (fn, _) in columns.items()])
    joined = attach(within, carried, parts)
    out = {n: _COMBINE[fn](F.col(n), F.col(f"_before_{n}")) for n, (fn, _) in columns.items()}
    return joined.withColumns(out).drop("_chunk", *[f"_before_{n}" for n in columns])


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns that ``other`` holds once per key; NULL keys match each other."""
    added = [c for c in other.columns if c not in keys]
    side = _renamed(other, keys)
    # one row where there are no keys
    joined = df.crossJoin(F.broadcast(side)) if list(keys) == [ALL] else df.join(side, _same(keys), "inner")
    return joined.select(*[F.col(c) for c in df.columns], *added)


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
