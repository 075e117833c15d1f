"""Medians and percentiles of groups of any size.

Spark's ``percentile`` keeps all values of a group in one task. Here the values are counted first (on the map side, so
a value that repeats costs one row per task), then a running count over the distinct values of a group tells which
ranks each value holds, and the two values around the wanted rank are picked by an aggregate. The running count is
that of ``operators/windows.py``: a group with more than ``hot_rows`` distinct values is cut into ordered chunks that
carry their totals, so no group has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.operators.windows import attach, running

_VALUE = "_blockquery_value"


def percentiles(df: DataFrame, keys: Sequence[str], value: str | Column, fractions: Mapping[str, float], hot_rows: int | None = None) -> DataFrame:
    """One row for each group, with the percentile of ``value`` at each fraction, as ``{output: fraction}``.

    Between two ranks it is interpolated, as by Spark's ``percentile``, whose values these are. NULL values do not
    count; a group of nothing else has NULL. NULL keys are a group. Without keys there is one row, also for an empty
    table. NaN is larger than any other value.
    """
    wrong = [f for f in fractions.values() if not 0 <= f <= 1]
    if wrong or not fractions:
        raise ValueError(f"fractions must be some numbers from 0 to 1, not {dict(fractions)}")
    source = df.select(*[F.col(f"`{k}`") for k in keys], (F.expr(value) if isinstance(value, str) else value).cast("double").alias(_VALUE))
    names = [f"`{k}`" for k in keys]
    counted = source.groupBy(*names, _VALUE).agg(F.count(_VALUE).alias("_rows"))  # 0 for NULL, so groups of NULLs stay
    upto = running(counted, list(keys), [_VALUE], {"_upto": ("sum", "_rows")}, hot_rows)
    sizes = source.groupBy(*names).agg(F.count(_VALUE).alias("_size"))
    placed = attach(upto, sizes, list(keys)) if keys else upto.crossJoin(F.broadcast(sizes))  # one row

    def rank(fraction: float) -> Column:
        return (F.col("_size") - 1) * F.lit(float(fraction))

    def at(position: Column) -> Column:
        held = (F.col("_upto") - F.col("_rows") <= position) & (position < F.col("_upto"))
        return F.max(F.when(held, F.col(_VALUE)))

    both = [c for i, f in enumerate(fractions.values()) for c in (at(F.floor(rank(f))).alias(f"_low{i}"), at(F.ceil(rank(f))).alias(f"_high{i}"))]
    picked = placed.groupBy(*names).agg(F.max("_size").alias("_size"), *both)

    def between(i: int, fraction: float) -> Column:
        low, high, position = F.col(f"_low{i}"), F.col(f"_high{i}"), rank(fraction)
        share = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
        return F.when((F.floor(position) == F.ceil(position)) | (low == high), low).otherwise(share)

    return picked.select(*names, *[between(i, f).alias(n) for i, (n, f) in enumerate(fractions.items())])
