"""The query block: clauses given in any order, applied in SQL order, as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.functions.names import base_of, column, join_type, last_part, split_names
from blockquery.operators.clauses import (
    Expressions,
    derive_columns,
    group_aggregate,
    rename_columns,
    sort_by,
    where_all,
)
from blockquery.operators.early import combined, partial_aggregates, reads_only
from blockquery.operators.joins import Join, join_on, unique_joins
from blockquery.operators.range_totals import join_totals
from blockquery.operators.window_text import window_columns
from blockquery.sources.tables import TableLookup


def query_block(
    tables: TableLookup | Mapping[str, DataFrame],
    base: str | None = None,
    *,
    joins: Iterable[Join] = (),
    where: str | Iterable[str] = (),
    group_by: str | Iterable[str | Column] = (),
    aggs: Expressions | None = None,
    having: str | Iterable[str] = (),
    windows: Expressions | None = None,
    with_columns: Expressions | None = None,
    select: str | Iterable[str | Column] | None = None,
    renames: Mapping[str, str] | None = None,
    distinct: bool = False,
    order_by: str | Iterable[str | Column] = (),
    limit: int | None = None,
    hot_rows: int | None = None,
    combine_early: str | None = None,
) -> DataFrame:
    """Build one query from its clauses.

    ``tables`` finds a table by name (a lookup function or a mapping). Every table is aliased with its
    name, so ``orders.id`` resolves. Without ``base``, the qualifier of the first qualified column of
    ``select`` names it. Names of ``select`` and ``group_by`` and keys of ``order_by`` may be packed in one
    string. Applied in this order: joins (repeats dropped), where (ANDed), grouping, having,
    windows, derived columns, select, renames, distinct, order, limit. A grouped block returns keys and
    aggregates; window and derived columns are appended to the output in both cases. Window texts over keys of
    more than ``hot_rows`` rows are split (``operators/window_text.py``), or refused where they cannot be. ``combine_early`` names the table of a grouped block
    that all aggregates read: it is grouped before the joins by what they, the predicates and the keys read of it
    (``operators/early.py``), which pays where that leaves few of its rows.
    """
    if (having or aggs) and not group_by:
        raise ValueError("having and aggs need group_by")

    def table(name: str) -> DataFrame:
        found = tables[name] if isinstance(tables, Mapping) else tables(name)
        return found.alias(last_part(name))

    chosen = None if select is None else split_names(select)
    first = base or base_of(chosen)
    joins = unique_joins(joins)
    aliases = [last_part(first)]
    if combine_early is None or not joins:
        if group_by:
            df = where_all(_grouped(table, first, joins, where, group_by, aggs or {}), having)
        else:
            df = _joined(table, first, joins, where)
    else:
        if not group_by or not aggs:
            raise ValueError("combine_early needs group_by and aggs")
        df = where_all(_combined_early(table, first, joins, where, group_by, aggs, combine_early), having)
    aliases += [last_part(j.table) for j in joins]
    added = {**(windows or {}), **(with_columns or {})}
    if windows:
        df = window_columns(df, windows, None if group_by or len(aliases) > 1 else aliases[0], hot_rows)
    if with_columns:
        df = derive_columns(df, with_columns)
    if chosen is not None and not group_by:
        kept = {last_part(s) for s in chosen if isinstance(s, str)}
        df = df.select(*[column(s) for s in chosen], *[column(f"`{n}`") for n in added if n not in kept])
    if renames:
        df = rename_columns(df, renames)
    if distinct:
        df = df.distinct()
    if order_by:
        df = sort_by(df, order_by, spread_ties=limit is None)
    return df if limit is None else df.limit(limit)


def _joined(table: TableLookup, first: str, joins: Iterable[Join], where: str | Iterable[str]) -> DataFrame:
    """The base table with all joins and predicates."""
    df, aliases = table(first), [last_part(first)]
    for j in joins:
        df = join_on(df, table(j.table), j.condition, j.how, j.hot_right, (aliases, [last_part(j.table)]))
        aliases = [*aliases, last_part(j.table)]
    return where_all(df, where)


def _grouped(
    table: TableLookup, first: str, joins: list[Join], where: str | Iterable[str], keys: str | Iterable[str | Column], aggs: Expressions
) -> DataFrame:
    """The grouped block; over a range join as the last one it is taken without the pairs where it can be."""
    if not joins:
        return group_aggregate(_joined(table, first, joins, where), keys, aggs)
    left, right, last = _joined(table, first, joins[:-1], ()), table(joins[-1].table), joins[-1]
    totals = join_totals(left, right, last, where, keys, aggs)
    if totals is not None:
        return totals
    aliases = [last_part(n) for n in (first, *[j.table for j in joins[:-1]])]
    df = join_on(left, right, last.condition, last.how, last.hot_right, (aliases, [last_part(last.table)]))
    return group_aggregate(where_all(df, where), keys, aggs)


def _combined_early(
    table: TableLookup,
    first: str,
    joins: list[Join],
    where: str | Iterable[str],
    group_by: str | Iterable[str | Column],
    aggs: Expressions,
    name: str,
) -> DataFrame:
    """The grouped block with the table ``name`` grouped below the joins.

    The plain block is analysed for its aggregates, with every join as an inner one, since types of columns are the same.
    Predicates on that table alone come before its grouping where no join can add rows without it.
    """
    names = [first, *[j.table for j in joins]]
    if names.count(name) != 1:
        raise ValueError(f"combine_early={name!r} must be one of the tables, and be there once")
    predicates = list(dict.fromkeys([where] if isinstance(where, str) else where))
    keys = split_names(group_by)
    source = table(name)
    plain = table(first)
    for j in joins:
        if join_type(j.how) not in ("left_semi", "left_anti"):
            plain = plain.join(table(j.table), F.expr(j.condition), "inner")
    partial = partial_aggregates(group_aggregate(plain, keys, aggs), list(aggs), source)
    inner = all(join_type(j.how) in ("inner", "cross", "left_semi", "left_anti") for j in joins)
    own = [p for p in predicates if inner and reads_only(source, p)]
    rest = [p for p in predicates if p not in own]
    texts = [*[j.condition for j in joins], *rest, *[k if isinstance(k, str) else str(k) for k in keys]]
    small = combined(source, last_part(name), texts, partial, lambda df: where_all(df, own))
    return _grouped(lambda n: small if n == name else table(n), first, joins, rest, keys, partial.after)
