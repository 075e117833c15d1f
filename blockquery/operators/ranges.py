"""Joins on a range condition whose two sides are both too large to be broadcast.

A row of either side reaches from a low to a high value, and two rows can only match if their reaches meet: a
condition with one "not above" and one "not below" between the sides has that form. Both
sides are cut at common boundaries, the quantiles of all low values, and between two of them evenly, so
a bucket holds about ``BUCKET`` rows however many there are and however their values are spread. A row is copied
into the buckets that it reaches and no others, the join runs on the bucket as an equality, and the
condition itself is checked on every pair that meets. A pair that shares several buckets is taken in the one where the
later of its two low values lies.

A bucket that stays crowded, because one value holds a large share of the rows, is cut into a grid: each
row goes to one part of its own side by hash, and is copied to all parts of the other one. So no task
gets more than about ``PART`` rows of either side of a bucket, and no row is dropped.

Rows with a NULL low or high value match nothing: an inner or semi join leaves them out, a left or
anti join keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from blockquery.operators.clauses import row_hash
from blockquery.sources.checkpoints import reliable

BUCKET = 500
"""Low values that a bucket should hold: a row is compared with about as many others."""

QUANTILES = 4096
"""Boundaries at most; beyond that, each stretch between two of them is cut evenly."""

PART = 200_000
"""Rows of one side of a bucket that meet in one task."""


@dataclass(frozen=True)
class Reach:
    """Where a row of one side lies: between two expressions on its columns, in either order."""

    one: str
    other: str


def range_join(
    left: DataFrame,
    right: DataFrame,
    condition: str | Column,
    left_reach: Reach,
    right_reach: Reach,
    how: str = "inner",
    part: int | None = None,
) -> DataFrame:
    """Join two aliased DataFrames on a condition that holds only for rows whose reaches meet.

    The reaches are numbers, dates or timestamps. Two passes over them, as soon as this is called, find the
    boundaries and the crowded buckets. All joins but the inner one number the rows of a side they have to keep, in
    a checkpoint, and look the numbers of matched rows up.
    """
    on = F.expr(condition) if isinstance(condition, str) else condition
    kept = {"l": left, "r": right}
    for side in {"left": "l", "left_semi": "l", "left_anti": "l", "right": "r", "full": "lr"}.get(how, ""):
        kept[side] = reliable(kept[side].withColumn(f"_{side}_row", F.monotonically_increasing_id()))
    if len({_kind(df, text) == TimestampNTZType() for df, reach in ((left, left_reach), (right, right_reach)) for text in (reach.one, reach.other)}) > 1:
        raise ValueError("a range join cannot compare timestamps without a time zone with other values")
    placed = [_placed(kept["l"], left_reach, "l"), _placed(kept["r"], right_reach, "r")]
    bounds = _boundaries(placed)
    cut = [_cut(df, bounds, side) for df, side in zip(placed, "lr", strict=True)]
    grid = _grid(cut, part or PART)
    dealt = [_dealt(df, grid, side, other) for df, side, other in zip(cut, "lr", "rl", strict=True)]
    same = [F.col(f"_l_{c}") == F.col(f"_r_{c}") for c in ("bucket", "own", "other")]
    once = F.col("_l_bucket") == F.greatest("_l_first", "_r_first")
    # Spark takes the size of a side for that before it was copied into buckets: a broadcast would build the copies in the driver
    pairs = dealt[0].join(dealt[1].hint("merge"), same[0] & same[1] & same[2] & once & on, "inner")

    def unmatched(side: str, keep: str = "left_anti") -> DataFrame:
        met = pairs.select(F.col(f"_{side}_row").alias("_met")).distinct()
        return kept[side].join(met, F.col(f"_{side}_row") == F.col("_met"), keep).drop(f"_{side}_row")

    if how in ("left_semi", "left_anti"):
        return unmatched("l", how)
    out = pairs.drop(*[f"_{side}_{c}" for side in "lr" for c in ("row", "bucket", "own", "other", "first")])
    if how in ("left", "full"):
        out = out.union(unmatched("l").select("*", *_nulls(right)))
    if how in ("right", "full"):
        out = out.union(unmatched("r").select(*_nulls(left), "*"))
    return out


def _nulls(df: DataFrame) -> list[Column]:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]


def number(value: Column, kind: DataType) -> Column:
    """A value as a double that never falls when the value rises."""
    if isinstance(kind, (DateType, TimestampType)):
        return value.cast("timestamp").cast("double")  # as Spark compares them with each other
    if isinstance(kind, TimestampNTZType):  # by its own clock, which no time zone sets back
        seconds = F.hour(value) * 3600 + F.minute(value) * 60
        return F.unix_date(value.cast("date")) * 86_400 + seconds + F.extract(F.lit("SECOND"), value).cast("double")
    if isinstance(kind, NumericType):
        return value.cast("double")
    raise ValueError(f"a range join needs numbers, dates or timestamps, not {kind.simpleString()}")


def _kind(df: DataFrame, text: str) -> DataType:
    return df.select(F.expr(text).alias("v")).schema["v"].dataType


def _placed(df: DataFrame, reach: Reach, side: str) -> DataFrame:
    ends = [number(F.expr(text), _kind(df, text)) for text in (reach.one, reach.other)]
    known = df.filter(ends[0].isNotNull() & ends[1].isNotNull())
    return known.withColumns({f"_{side}_low": F.least(*ends), f"_{side}_high": F.greatest(*ends)})


@dataclass(frozen=True)
class Buckets:
    """Rising boundaries, the first of which is the least value, and the number of buckets from one to the next."""

    bounds: list[float]
    even: int

    def of(self, value: Column) -> Column:
        """The bucket of a value; it never falls when the value rises."""
        if not self.bounds:
            return F.lit(0).cast("long")
        at = F.greatest(bucket_of(value, self.bounds) - 1, F.lit(0))
        if self.even == 1:
            return at.cast("long")
        widths = [self.even / (b - a) if b - a > 0 else 0.0 for a, b in zip(self.bounds, self.bounds[1:])] + [0.0]
        inside = F.floor((value - F.get(_numbers(self.bounds), at)) * F.get(_numbers(widths), at))
        return at.cast("long") * self.even + F.greatest(F.least(inside.cast("long"), F.lit(self.even - 1)), F.lit(0))


def _boundaries(sides: list[DataFrame]) -> Buckets:
    """Quantiles of the low values of both sides, each once, between the least and the largest."""
    lows = sides[0].select(F.col("_l_low").alias("low")).union(sides[1].select(F.col("_r_low").alias("low")))
    rows, least, most = lows.filter("NOT isnan(low)").agg(F.count("*"), F.min("low"), F.max("low")).first()
    wanted = -(-rows // BUCKET)
    if wanted < 2 or least == most:
        return Buckets([], 1)
    quantiles = min(QUANTILES, wanted)
    shares = [i / quantiles for i in range(1, quantiles)]
    found = lows.agg(F.percentile_approx("low", shares, 4 * QUANTILES).alias("b")).first()["b"]
    return Buckets(sorted({least, most, *found} - {float("inf"), float("-inf")} | {least}), -(-wanted // quantiles))


def _numbers(values: list[float]) -> Column:
    """An array as one literal, also of many thousand numbers."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted boundaries are not above a value: a binary search, one step for each power of two."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = _numbers(bounds)
    # beyond the last boundary the table gives NULL, and the place stays
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def _cut(df: DataFrame, bounds: Buckets, side: str) -> DataFrame:
    """Each row once for every bucket that it reaches."""
    first, last = (bounds.of(F.col(f"_{side}_{end}")) for end in ("low", "high"))
    placed = df.withColumns({f"_{side}_first": first, f"_{side}_last": last}).drop(f"_{side}_low", f"_{side}_high")
    return placed.withColumn(f"_{side}_bucket", F.explode(F.sequence(f"_{side}_first", f"_{side}_last"))).drop(f"_{side}_last")


def _grid(cut: list[DataFrame], part: int) -> DataFrame | None:
    """Parts of each side of the buckets that need several, or nothing."""
    counts = [
        side.groupBy(F.col(f"_{s}_bucket").alias("bucket")).agg(F.count("*").alias(f"n_{s}")) for side, s in zip(cut, "lr", strict=True)
    ]
    both = counts[0].join(counts[1], "bucket")  # a bucket without rows of one side has no pairs
    parts = both.select("bucket", *[F.ceil(F.col(f"n_{s}") / part).cast("int").alias(f"parts_{s}") for s in "lr"])
    crowded = reliable(parts.filter("parts_l > 1 OR parts_r > 1"))
    return None if crowded.isEmpty() else crowded


def _dealt(df: DataFrame, grid: DataFrame | None, side: str, other: str) -> DataFrame:
    """Rows of crowded buckets in one part of their own side and in all of the other; ``own`` is the part of the left side."""
    names = [f"_{side}_own", f"_{side}_other"]
    if side == "r":
        names.reverse()
    if grid is None:
        return df.withColumns({n: F.lit(0) for n in names})
    parts = grid.withColumnsRenamed({c: f"_{side}_{c}" for c in ("parts_l", "parts_r")})
    joined = df.join(parts, F.col(f"_{side}_bucket") == F.col("bucket"), "left").drop("bucket")
    hashed = row_hash(df)
    mine, theirs = (F.coalesce(F.col(f"_{side}_parts_{s}"), F.lit(1)) for s in (side, other))
    spread = joined.withColumns({names[0]: F.pmod(hashed, mine).cast("int"), names[1]: F.explode(F.sequence(F.lit(0), theirs - 1))})
    return spread.drop(f"_{side}_parts_l", f"_{side}_parts_r")
