"""Window frames by value: aggregates over the rows of a key whose value lies near that of the current row.

Rows that tie are one row of the work: they are grouped by key and value first, on the map side. Keys that still
have more than ``hot_rows`` values are cut into ordered chunks, and each chunk gets copies of the values that reach
over its borders: as many as lie within the frame's width, so no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from blockquery.operators import windows as win


def value_frames(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    columns: Mapping[str, tuple[str, str | Column]],
    before: float,
    after: float,
    hot_rows: int | None = None,
) -> DataFrame:
    """Aggregates over the rows of a key whose ``by`` is from ``before`` below to ``after`` above that of the row.

    ``columns`` maps an output name to ``(function, value)`` with sum, count, min or max; ``by`` is a number. As in
    any such frame, rows whose ``by`` is NULL see each other only. ``keys`` may be empty.
    """
    if not keys:
        whole = value_frames(df.withColumn(win.ALL, F.lit(0)), [win.ALL], by, columns, before, after, hot_rows)
        return whole.drop(win.ALL)
    parts = {n: getattr(F, fn)(value).alias(f"_{n}") for n, (fn, value) in columns.items()}
    grouped = df.groupBy(*keys, by).agg(*parts.values())
    totals = {n: (win.TOTAL[fn], grouped.schema[f"_{n}"].dataType) for n, (fn, _) in columns.items()}

    def framed(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        window = W.partitionBy(*within).orderBy(by).rangeBetween(-before, after)
        return rows.withColumns({n: total(f"_{n}").over(window).cast(kind) for n, (total, kind) in totals.items()})

    cold, hot = win.split_hot(grouped.filter(F.col(by).isNotNull()), keys, hot_rows)
    out = framed(cold, keys).select(*keys, by, *columns)
    if hot is not None:
        rows = hot.chunked([by])
        ends = rows.groupBy(*keys, "_chunk").agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
        ends = ends.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        near = F.col(by).between(F.col("_low") - before, F.col("_high") + after)
        copies = rows.drop("_chunk").join(ends, [*same, near], "inner")
        own = framed(copies, [*keys, "_chunk"]).filter(F.col(by).between(F.col("_low"), F.col("_high")))
        out = out.union(own.select(*keys, by, *columns))
    alone = grouped.filter(F.col(by).isNull()).select(*keys, by, *[F.col(f"_{n}").alias(n) for n in columns])
    return win.attach(df, out.union(alone), [*keys, by])
