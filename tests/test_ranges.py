"""Range joins of two large sides give the rows of Spark's own join, whatever is crowded, inverted or missing."""

import random

import pytest
from pyspark.sql import functions as F

from blockquery.operators import ranges
from blockquery.operators.joins import join_on
import __spark_entry__ as spark_entry
from tests import frames

FOLDER = "/root/testdata/sf0.001"
BETWEEN = "p.v BETWEEN s.low AND s.high"
OVERLAP = "s.low <= t.high AND t.low <= s.high"
HOWS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def spans(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, low, low + rng.choice([0, 1, 3, 40, -2]), "s") for i in range(n) for low in [rng.randrange(100)]]
    rows += [(n, None, 5, "s"), (n + 1, 5, None, "s"), (n + 2, -50, 500, "s"), (n + 3, 1000, 1001, "s")] + rows[:2]
    return spark.createDataFrame(rows, "id int, low int, high int, kind string")


def points(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(110), "p") for i in range(n)] + [(n, None, "p"), (n, None, "p"), (n + 1, -9, "p")]
    return spark.createDataFrame(rows + rows[:2], "id int, v int, kind string")


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(ranges, "BUCKET", 2)
    monkeypatch.setattr(ranges, "QUANTILES", 12)
    monkeypatch.setattr(ranges, "PART", 15)


@pytest.mark.parametrize("how", HOWS)
def test_points_in_spans(spark, small_buckets, how):
    p, s = points(spark, 150, 1).alias("p"), spans(spark, 60, 2).alias("s")
    others = ("s.low < p.v AND p.v <= s.high + 1 AND p.id > s.id", "p.v + 0.5D >= s.low AND p.v - 0.5D <= s.high")
    for condition in (BETWEEN, *(others if how in ("inner", "full") else ())):
        ours, plain = join_on(p, s, condition, how), p.join(s, F.expr(condition), how)
        assert ours.columns == plain.columns and frames.rows_of(ours) == frames.rows_of(plain)


@pytest.mark.parametrize("how", ["inner", "full", "left_semi"])
def test_spans_that_overlap(spark, small_buckets, how):
    s, t = spans(spark, 60, 3).alias("s"), spans(spark, 40, 4).alias("t")
    ours, plain = join_on(s, t, OVERLAP, how), s.join(t, F.expr(OVERLAP), how)
    assert frames.rows_of(ours) == frames.rows_of(plain)
    if not how.startswith("left_"):
        assert frames.rows_of(ours.select("s.id", "t.id")) == frames.rows_of(plain.select("s.id", "t.id"))


def test_dates_timestamps_and_empty_sides(spark, small_buckets):
    days = spark.sql("SELECT id, date_add(DATE'1969-12-20', cast(id % 40 AS int)) AS d FROM range(100)").alias("p")
    times = spark.sql("SELECT id, timestamp_seconds(id * 50000 - 900000) AS low, timestamp_seconds(id * 50000 - 700000) AS high FROM range(60)").alias("s")
    condition = "p.d >= s.low AND p.d < s.high"
    assert frames.rows_of(join_on(days, times, condition)) == frames.rows_of(days.join(times, F.expr(condition)))
    none = points(spark, 5, 1).filter("id < 0").alias("p")
    assert join_on(none, spans(spark, 5, 1).alias("s"), BETWEEN).count() == 0
    with pytest.raises(ValueError, match="needs numbers"):
        words = spark.createDataFrame([("a",)], "v string").alias("p")
        join_on(words, spark.createDataFrame([("a", "b")], "low string, high string").alias("s"), BETWEEN)


def test_a_later_join_reads_columns_of_a_range_join(spark, small_buckets):
    p, s = points(spark, 40, 1).alias("p"), spans(spark, 30, 2).alias("s")
    third = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string").alias("n")
    ours = join_on(join_on(p, s, BETWEEN, "left"), third, "s.id = n.id").select("p.id", "s.id", "n.name")
    plain = p.join(s, F.expr(BETWEEN), "left").join(third, F.expr("s.id = n.id")).select("p.id", "s.id", "n.name")
    assert frames.rows_of(ours) == frames.rows_of(plain)


@pytest.mark.parametrize(
    "condition",
    [
        "p.id = p.v AND p.v > s.low",  # the equality is over one side
        "p.v = s.low OR p.id > 3",
        "NOT (p.v = s.low)",
        "p.v < s.low",  # bounded on one side only
        "p.v < s.low AND p.id < s.high",
    ],
)
def test_what_would_compare_all_rows_is_refused(spark, condition):
    p, s = points(spark, 5, 1).alias("p"), spans(spark, 5, 1).alias("s")
    for how in ("inner", "left", "full"):
        with pytest.raises(ValueError, match="no equality"):
            join_on(p, s, condition, how)


def test_equalities_in_any_spelling_are_found(spark):
    p, s = points(spark, 30, 1).alias("p"), spans(spark, 30, 1).alias("s")
    for condition in ("(p.v = s.low) AND (p.id > s.id)", "p.v <=> s.low", "coalesce(p.v, 0) + 1 = s.low AND NOT (p.id = s.id)"):
        assert frames.rows_of(join_on(p, s, condition, "full")) == frames.rows_of(p.join(s, F.expr(condition), "full"))


def test_the_plan_has_no_nested_loop_and_a_crowded_bucket_is_spread(spark, small_buckets):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = spark_entry.queries()["join_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text
        p = spark.range(3000).select((F.col("id") % 7).alias("id"), F.lit(5).alias("v"), F.col("id").alias("n")).alias("p")
        s = spark.range(30).select("id", F.lit(5).alias("low"), F.lit(6).alias("high")).alias("s")
        joined = ranges.range_join(p, s, BETWEEN, ranges.Reach("p.v", "p.v"), ranges.Reach("s.low", "s.high"), part=400)
        assert joined.count() == 90_000
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 2 and max(sizes) < 45_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_side_is_broadcast_for_its_size_before_it_is_copied_into_buckets(spark, small_buckets):
    p = spark.range(500).select("id", F.col("id").cast("double").alias("v")).alias("p")
    s = spark.range(200).select("id", (F.col("id") * 2).cast("double").alias("low"), (F.col("id") * 2 + 100).cast("double").alias("high")).alias("s")
    joined = ranges.range_join(p, s, BETWEEN, ranges.Reach("p.v", "p.v"), ranges.Reach("s.low", "s.high"), part=10**6)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert joined.count() == p.join(s, F.expr(BETWEEN)).count()


def test_buckets_never_fall(spark):
    values = sorted({random.Random(6).choice([1, 50, 1000]) * random.Random(i).random() - 20 for i in range(300)})
    data = spark.createDataFrame([(v,) for v in values], "v double")
    for bounds, even in ([], 1), ([-20.0, 0.0, 0.5, 7.0, 400.0], 1), ([-20.0, 0.0, 0.5, 7.0, 400.0], 9):
        found = [r.b for r in data.select("v", ranges.Buckets(bounds, even).of(F.col("v")).alias("b")).orderBy("v").collect()]
        assert found == sorted(found) and len(set(found)) > (len(bounds) - 2) * even // 2


@pytest.mark.parametrize("bounds", [[], [1.0], [1.0, 2.0, 5.0], [float(i) for i in range(1000)]])
def test_buckets_by_binary_search(spark, bounds):
    values = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 5.0, 6.0, 998.5, 999.0, 2000.0, float("inf")]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranges.bucket_of(F.col("v"), bounds).alias("b")).collect()
    assert all(r.b == sum(b <= r.v for b in bounds) for r in found)
