"""Windows as text: what is read, and that hot keys are split with the values of Spark's own windows."""

import pytest
from pyspark.sql import functions as F

from blockquery.operators.window_text import read_calls, window_columns
from blockquery.plans.block import query_block

KEYED = "PARTITION BY k ORDER BY o DESC, i"
TEXTS = [
    f"row_number() OVER ({KEYED})",
    "cast(rank() OVER (PARTITION BY k ORDER BY o) AS bigint)",
    "dense_rank() OVER (PARTITION BY k ORDER BY o DESC)",
    f"ntile(7) OVER ({KEYED})",
    f"lag(v) OVER ({KEYED})",
    f"lead(v, 3) OVER ({KEYED})",
    f"sum(v) OVER ({KEYED} ROWS UNBOUNDED PRECEDING)",
    f"count(*) OVER ({KEYED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "sum(v) OVER (PARTITION BY k ORDER BY o)",
    "count(v) OVER (PARTITION BY k ORDER BY o DESC)",
    "min(v + 1) OVER (PARTITION BY k ORDER BY o)",
    f"max(v) OVER ({KEYED} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    f"avg(v) OVER ({KEYED} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "v / sum(v) OVER (PARTITION BY k) + max(v) OVER (PARTITION BY o)",
    "row_number() OVER (ORDER BY o, i)",
    "sum(v) OVER (ORDER BY o)",
    "coalesce(lag(t.v) OVER (PARTITION BY t.k ORDER BY t.o, t.i), -1)",
]


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    v = F.when(i % 11 != 0, i % 97)
    k = F.when(i % 3 == 0, "hot").when(i % 13 != 0, F.concat(F.lit("k"), i % 40))
    return spark.range(600).select(i.alias("i"), k.alias("k"), (i * 7 % 50).alias("o"), v.alias("v")).cache()


@pytest.mark.parametrize("text", TEXTS)
def test_split_windows_equal_sparks_own(table, text):
    expected = table.alias("t").withColumn("w", F.expr(text))
    found = query_block({"t": table}, "t", windows={"w": text}, hot_rows=50)
    assert found.schema["w"].dataType == expected.schema["w"].dataType and found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_several_windows_and_an_output_that_replaces_a_column(table):
    windows = {"v": "sum(v) OVER (PARTITION BY k)", "n": f"count(v) OVER ({KEYED})", "c": F.col("i") + 1}
    expected = table.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in windows.items()})
    found = window_columns(table, windows, hot_rows=50)
    assert found.columns == expected.columns and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_the_hot_key_is_cut_in_chunks(table):
    plan = window_columns(table, {"w": TEXTS[0]}, hot_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan
    plain = window_columns(table, {"w": TEXTS[0]}, hot_rows=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" not in plain and "Union" not in plain


@pytest.mark.parametrize("text", ["collect_list(v) OVER (PARTITION BY k ORDER BY o)", "sum(v) OVER (PARTITION BY upper(k))", "percent_rank() OVER (PARTITION BY k ORDER BY o)"])
def test_what_cannot_be_split_is_refused_above_the_size_only(table, text):
    assert window_columns(table, {"w": text}, hot_rows=1000).count() == 600
    with pytest.raises(ValueError, match="hot_rows"):
        window_columns(table, {"w": text}, hot_rows=50)


def test_reading():
    (call,) = read_calls("round(avg( a.v ) over (partition by a.k, `b c` order by o desc nulls last rows between 3 preceding and current row), 2)")
    assert (call.function, call.arguments, call.keys, call.order) == ("avg", ("a.v",), ("k", "b c"), ("o desc nulls last",))
    assert read_calls("a + 1") == [] and read_calls("'x OVER (y)'") == []
    assert read_calls("sum(v) OVER w") is None


def test_an_empty_table(table):
    assert window_columns(table.filter("false"), {"w": TEXTS[0], "x": TEXTS[-2]}, hot_rows=1).collect() == []
