"""Every window operator gives the same values with hot keys split as Spark's own window gives."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from blockquery.functions.names import sort_column
from blockquery.operators import windows as win

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows; key 0 holds about half of them, one key is NULL, values have ties and NULLs."""
    return (
        spark.range(900, numPartitions=4)
        .select(
            F.when(F.col("id") % 2 == 0, F.lit(0)).when(F.col("id") % 97 == 1, None).otherwise(F.col("id") % 50).cast("long").alias("k"),
            ((F.col("id") * 7919) % 213).alias("ts"),
            "id",
            F.when(F.col("id") % 11 != 0, (F.col("id") * 31) % 101).alias("v"),
        )
        .cache()
    )


def same(actual, expected):
    assert sorted(actual.columns) == sorted(expected.columns)
    columns = sorted(expected.columns)
    assert actual.count() == expected.count()
    assert actual.select(columns).exceptAll(expected.select(columns)).isEmpty()


@pytest.fixture(params=[12, 150, 10_000_000], ids=["most keys hot", "one key hot", "none hot"])
def hot_rows(request):
    return request.param


def plain():
    return W.partitionBy("k").orderBy(*ORDER)


def test_running(rows, hot_rows):
    w = plain().rowsBetween(W.unboundedPreceding, 0)
    spec = {f: (f, "v") for f in ("sum", "count", "min", "max")}
    same(
        win.running(rows, ["k"], ORDER, spec, hot_rows),
        rows.withColumns({f: getattr(F, f)("v").over(w) for f in spec}),
    )


def test_running_descending_order(rows, hot_rows):
    w = W.partitionBy("k").orderBy(F.desc("ts"), "id").rowsBetween(W.unboundedPreceding, 0)
    same(win.running(rows, ["k"], ["ts desc", "id"], {"s": ("sum", "v")}, hot_rows), rows.withColumn("s", F.sum("v").over(w)))


def test_row_numbers(rows, hot_rows):
    same(win.row_numbers(rows, ["k"], ORDER, "n", hot_rows), rows.withColumn("n", F.row_number().over(plain()).cast("long")))


@pytest.mark.parametrize("tiles", [1, 7, 700])
def test_ntiles(rows, hot_rows, tiles):
    same(win.ntiles(rows, ["k"], ORDER, tiles, "t", hot_rows), rows.withColumn("t", F.ntile(tiles).over(plain()).cast("long")))


def test_ranks(rows, hot_rows):
    w = W.partitionBy("k").orderBy("v")
    same(
        win.ranks(rows, ["k"], "v", "r", "d", hot_rows),
        rows.withColumns({"r": F.rank().over(w).cast("long"), "d": F.dense_rank().over(w).cast("long")}),
    )


def test_neighbours(rows, hot_rows):
    columns = {
        "back": lambda w: F.lag("v").over(w),
        "ahead": lambda w: F.lead("v", 2).over(w),
        "moving": lambda w: F.sum("v").over(w.rowsBetween(-3, 1)),
    }
    same(
        win.neighbours(rows, ["k"], ORDER, columns, before=3, after=2, hot_rows=hot_rows),
        rows.withColumns({n: c(plain()) for n, c in columns.items()}),
    )


def test_neighbours_reaching_over_several_blocks(rows):
    columns = {"back": lambda w: F.lag("v", 25).over(w), "ahead": lambda w: F.lead("v", 25).over(w)}
    same(
        win.neighbours(rows, ["k"], ORDER, columns, before=25, after=25, hot_rows=12),
        rows.withColumns({n: c(plain()) for n, c in columns.items()}),
    )


def test_partition_totals_and_ends(rows):
    w = plain().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = win.partition_totals(rows, ["k"], {"total": F.sum("v")})
    same(out, rows.withColumn("total", F.sum("v").over(W.partitionBy("k"))))
    ends = win.first_last(rows, ["k"], ORDER, {"first": "id"}, {"last": "id"})
    same(ends, rows.withColumns({"first": F.first("id").over(w), "last": F.last("id").over(w)}))


@pytest.mark.parametrize("n", [3, 1100])
def test_top_rows(rows, hot_rows, n):
    expected = rows.withColumn("n", F.row_number().over(plain())).filter(F.col("n") <= n).drop("n")
    same(win.top_rows(rows, ["k"], ORDER, n), expected)


@pytest.mark.parametrize("order", [["v DESC", "id"], ["v", "id DESC"]])
def test_first_last_in_either_direction(rows, order):
    w = W.partitionBy("k").orderBy(*map(sort_column, order)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    expected = rows.withColumns({"a": F.first("id").over(w), "b": F.last("id").over(w)})
    same(win.first_last(rows, ["k"], order, {"a": "id"}, {"b": "id"}), expected)


@pytest.mark.parametrize("hot_rows", [12, None])
def test_ranks_by_several_columns_in_either_direction(rows, hot_rows):
    tied = rows.withColumn("m", F.col("v") % 3)
    w = W.partitionBy("k").orderBy(F.desc("m"), "v")
    expected = tied.withColumns({"r": F.rank().over(w).cast("long"), "d": F.dense_rank().over(w).cast("long")})
    same(win.ranks(tied, ["k"], ["m DESC", "v"], "r", "d", hot_rows), expected)


def test_types_do_not_depend_on_hot_keys(rows):
    exact = rows.withColumn("money", F.col("v").cast("decimal(18,2)"))
    sums = {"s": ("sum", "money"), "c": ("count", F.lit(1))}
    assert win.running(exact, ["k"], ORDER, sums, 12).dtypes == win.running(exact, ["k"], ORDER, sums, 10**9).dtypes


def test_two_key_columns(rows):
    two = rows.withColumn("k2", F.col("v") % 2)
    w = W.partitionBy("k", "k2").orderBy(*ORDER)
    same(win.row_numbers(two, ["k", "k2"], ORDER, "n", 50), two.withColumn("n", F.row_number().over(w).cast("long")))


def test_hot_rows_are_spread(rows):
    _, hot = win.split_hot(rows, ["k"], 150)
    sizes = [r["count"] for r in hot.chunked(ORDER).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 450 and max(sizes) < 200
