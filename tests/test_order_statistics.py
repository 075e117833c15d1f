"""Percentiles equal Spark's own, whatever the size of a group, and no group meets in one task."""

import pytest
from pyspark.sql import functions as F

from blockquery.operators.order_statistics import percentiles
from tests.test_plans import plan

FRACTIONS = {"lo": 0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "hi": 1}
TEXTS = {n: f"percentile(v, {f})" for n, f in FRACTIONS.items()}


def data(spark):
    rows = [("hot", float(i * 37 % 1009)) for i in range(900)] + [("ties", float(i % 3)) for i in range(50)]
    rows += [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None), ("none", None), (None, 3.0), (None, None), ("hot", None)]
    rows += [("nan", float("nan")), ("nan", 1.0), ("signs", -0.5), ("signs", 0.25), ("signs", -7.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(4)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hot_rows", [None, 40])
def test_equal_to_percentile(spark, hot_rows):
    df = data(spark)
    expected = df.groupBy("k").agg(*[F.expr(t).alias(n) for n, t in TEXTS.items()])
    assert rows_of(percentiles(df, ["k"], "v", FRACTIONS, hot_rows)) == rows_of(expected)
    df = df.filter("NOT isnan(v)")
    expected = df.agg(*[F.expr(t).alias(n) for n, t in TEXTS.items()])
    assert rows_of(percentiles(df, [], "v", FRACTIONS, hot_rows)) == rows_of(expected)


def test_empty_tables_expressions_and_awkward_names(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert percentiles(empty, ["k"], "v", FRACTIONS).count() == 0
    assert percentiles(empty, [], "v", {"mid": 0.5}).collect() == [(None,)]
    df = data(spark).withColumnRenamed("k", "the key")
    expected = df.groupBy("`the key`").agg(F.expr("percentile(v * 2, 0.5)").alias("mid"))
    assert rows_of(percentiles(df, ["the key"], "v * 2", {"mid": 0.5})) == rows_of(expected)
    with pytest.raises(ValueError):
        percentiles(empty, ["k"], "v", {"x": 1.5})


def test_no_task_holds_a_group(spark):
    """With its groups cut, the running counts are over chunks of a group, and no aggregate collects values."""
    text = plan(percentiles(data(spark), ["k"], "v", {"mid": 0.5}, hot_rows=40))
    assert "percentile" not in text and "collect_list" not in text
    chunked = percentiles(data(spark), ["k"], "v", {"mid": 0.5}, hot_rows=40)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in chunked
