"""The single-table operators: projection, filter, grouping, distinct, sort, limit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from blockquery.functions.names import column, sort_column, split_names, split_sorts

Expressions = Mapping[str, "str | Column"]


def named(expressions: Expressions) -> dict[str, Column]:
    """Expression texts by output name, as columns."""
    return {name: F.expr(e) if isinstance(e, str) else e for name, e in expressions.items()}


def select_columns(df: DataFrame, *names: str | Column) -> DataFrame:
    return df.select(*[column(n) for n in split_names(names)])


def where_all(df: DataFrame, predicates: str | Iterable[str]) -> DataFrame:
    """All predicates must hold; exact repeats count once."""
    unique = dict.fromkeys([predicates] if isinstance(predicates, str) else predicates)
    return df.filter(reduce(and_, map(F.expr, unique))) if unique else df


def group_aggregate(df: DataFrame, keys: str | Iterable[str | Column], aggs: Expressions) -> DataFrame:
    """Keys and aggregates. Spark aggregates on the map side first, so hot keys shrink before the shuffle."""
    if not aggs:
        raise ValueError("group_by needs aggregates, for example {'count': 'count(*)'}")
    return df.groupBy(*[column(k) for k in split_names(keys)]).agg(*[e.alias(n) for n, e in named(aggs).items()])


def derive_columns(df: DataFrame, expressions: Expressions) -> DataFrame:
    return df.withColumns(named(expressions))


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Renames replace the old name; a name that is absent is left alone."""
    return df.withColumnsRenamed(dict(renames))


def sort_by(df: DataFrame, keys: str | Iterable[str | Column], spread_ties: bool = False) -> DataFrame:
    """Sort by written keys.

    A sorted table is range-partitioned, and rows that tie on every key share one partition.
    ``spread_ties`` adds a hash of the row as last key, so a value that many rows share is spread too. Columns
    that cannot be hashed, such as maps, are left out of it.
    """
    order = [sort_column(k) for k in split_sorts(keys)]
    if spread_ties and len(set(df.columns)) == len(df.columns):
        order.append(row_hash(df))
    return df.orderBy(*order)


def row_hash(df: DataFrame) -> Column:
    """A hash of each row: of all columns that can be hashed and whose name is theirs alone."""
    names = [c.lower() for c in df.columns]
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType) and names.count(f.name.lower()) == 1])


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))
