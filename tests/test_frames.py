"""Windows without keys and frames by value: hot or not, they give the rows of Spark's own windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from blockquery.operators import windows as win
from blockquery.operators.frames import value_frames
from tests import frames


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 3 else rng.choice("bc"), rng.randrange(40), None if i % 11 == 0 else rng.randrange(9)) for i in range(180)]
    rows += [(900 + i, "a", None, i) for i in range(3)] + [(950, None, 4, 1), (951, None, None, 2)]
    return spark.createDataFrame(rows, "id int, k string, day int, v int").cache()


@pytest.mark.parametrize("hot", [25, 10_000])
def test_windows_without_keys(data, hot):
    w = W.orderBy("day", "id")
    rows = w.rowsBetween(W.unboundedPreceding, 0)
    ours = win.running(data, [], ["day", "id"], {"s": ("sum", "v"), "n": ("count", F.lit(1)), "m": ("max", "v")}, hot)
    assert frames.rows_of(ours) == frames.rows_of(data.withColumns({"s": F.sum("v").over(rows), "n": F.count(F.lit(1)).over(rows), "m": F.max("v").over(rows)}))
    ours = win.ntiles(data, [], ["day", "id"], 7, "t", hot)
    assert frames.rows_of(ours) == frames.rows_of(data.withColumn("t", F.ntile(7).over(w).cast("long")))
    ours = win.neighbours(data, [], ["day", "id"], {"p": lambda x: F.lag("v", 2).over(x)}, 2, 0, hot)
    assert frames.rows_of(ours) == frames.rows_of(data.withColumn("p", F.lag("v", 2).over(w)))
    ours = win.ranks(data, [], "day", "r", "d", hot).select("id", "r", "d")
    by_day = W.orderBy("day")
    assert frames.rows_of(ours) == frames.rows_of(data.select("id", F.rank().over(by_day).alias("r"), F.dense_rank().over(by_day).alias("d")))
    ours = win.partition_totals(data, [], {"s": F.sum("v")})
    assert frames.rows_of(ours) == frames.rows_of(data.withColumn("s", F.sum("v").over(W.partitionBy())))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("hot", [6, 10_000])
def test_frames_by_value(data, hot, keys):
    for before, after in ((3, 2), (0, 0), (50, 50)):
        window = W.partitionBy(*keys).orderBy("day").rangeBetween(-before, after)
        ours = value_frames(data, keys, "day", {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, before, after, hot)
        plain = data.withColumns({"s": F.sum("v").over(window), "n": F.count("v").over(window), "lo": F.min("v").over(window), "hi": F.max("v").over(window)})
        assert ours.schema == plain.schema or [f.dataType for f in ours.schema] == [f.dataType for f in plain.schema]
        assert frames.rows_of(ours) == frames.rows_of(plain)


def test_a_table_without_keys_is_cut_into_chunks(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 50).alias("v"))
    placed = win.running(rows, [], ["id"], {"s": ("sum", "v")}, hot_rows=500)
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2000
    assert placed.agg(F.max("s")).first()[0] == sum(i % 50 for i in range(4000))


def test_empty_tables(data):
    none = data.filter("id < 0")
    assert win.running(none, [], ["id"], {"n": ("count", F.lit(1))}).count() == 0
    assert value_frames(none, [], "day", {"n": ("count", F.lit(1))}, 1, 1).count() == 0
