"""Grouped aggregates over a range join are those of the plain block, and its pairs are not made."""

import random

import pytest
from pyspark.sql import functions as F

from blockquery.operators import joins, range_totals, windows
from blockquery.operators.joins import Join
from blockquery.plans.block import query_block
from tests import frames

AGGS = {
    "n": "count(*)",
    "ones": "count(1)",
    "counted": "count(p.w)",
    "total": "sum(p.w)",
    "cents": "cast(sum(cast(p.w AS decimal(10,2))) AS double)",
    "mean": "avg(p.w)",
    "lo": "min(p.w)",
    "hi": "max(p.w + 1)",
    "share": "round(sum(p.w) / count(*), 6)",
}
NAN = float("nan")


def tables(spark, n=150, m=70, far=110):
    rng = random.Random(n)
    p = [(i, rng.randrange(far), rng.choice([None, i % 9]), rng.choice([0.0, -0.0, 2.5, NAN, None, rng.random() * 9]), rng.choice("ab")) for i in range(n)]
    s = [(i, low, low + rng.choice([0, 1, 2, 3, 7, 40, -2]), rng.choice([0.0, 2.5, NAN, None, rng.random() * 9]), rng.choice(["x", "y", None])) for i in range(m) for low in [rng.randrange(far)]]
    p += p[:9] + [(n, None, 3, 1.0, "a"), (n, 5, 3, 1.0, None)]
    s += s[:5] + [(m, None, 5, 1.0, "x"), (m, 5, None, 1.0, "y"), (m, -50, 500, 1.0, "x"), (m, 1000, 1001, 1.0, "z")]
    return {
        "p": spark.createDataFrame(p, "id int, v int, w int, price double, kind string"),
        "s": spark.createDataFrame(s, "id int, low int, high int, price double, place string"),
    }


@pytest.fixture
def no_pairs(monkeypatch):
    def made(*args):
        raise AssertionError("the pairs are made")

    monkeypatch.setattr(joins, "range_join", made)


def plain(given, base, other, condition, keys, aggs, where=()):
    joined = given[base].alias(base).join(given[other].alias(other), F.expr(condition))
    for text in where:
        joined = joined.filter(text)
    return joined.groupBy(*keys).agg(*[F.expr(t).alias(n) for n, t in aggs.items()])


@pytest.mark.parametrize(
    "condition, base, keys, hot_rows",
    [
        ("p.v BETWEEN s.low AND s.high", "p", ["place", "kind"], None),
        ("p.v > s.low AND p.v < s.high", "s", ["p.kind"], None),
        ("s.low < p.v AND p.v <= s.high AND p.price > s.price", "s", ["place", "kind"], None),
        ("s.low < p.v AND p.v <= s.high AND p.price > s.price", "p", ["place", "kind"], 20),
        ("p.v >= s.low AND p.v < s.low + 2 AND p.price >= s.price", "p", ["s.place"], None),
        ("p.v >= s.low AND p.v < s.high + 30 AND p.price < s.price AND s.id > 3 AND p.w IS NOT NULL", "p", ["kind", "place"], 20),
        ("p.v BETWEEN s.low AND s.high AND NOT (p.id = 4) AND s.price BETWEEN -1 AND 8 AND p.id <= s.id", "p", ["place", "kind"], None),
    ],
)
def test_as_the_plain_block(spark, no_pairs, monkeypatch, condition, base, keys, hot_rows):
    monkeypatch.setattr(windows, "HOT_ROWS", hot_rows or windows.HOT_ROWS)
    given, other = tables(spark), "s" if base == "p" else "p"
    ours = query_block(given, base, joins=[Join(other, condition)], group_by=keys, aggs=AGGS)
    want = plain(given, base, other, condition, keys, AGGS)
    assert ours.schema == want.schema
    assert frames.rows_of(ours) == frames.rows_of(want) != []


def test_aggregates_of_the_spans_and_of_neither_side(spark, no_pairs):
    given, condition = tables(spark), "p.v BETWEEN s.low AND s.high AND p.price <= s.price"
    for aggs in ({"t": "sum(s.id)", "n": "count(*)", "m": "min(s.high)"}, {"n": "count(*)"}):
        ours = query_block(given, "p", joins=[Join("s", condition, "cross")], where="p.id > 9", group_by="kind, place", aggs=aggs)
        want = plain(given, "p", "s", condition, ["kind", "place"], aggs, ["p.id > 9"])
        assert frames.rows_of(ours) == frames.rows_of(want) != []


def test_times_of_many_values_and_long_spans(spark, no_pairs):
    p = spark.sql("SELECT id, timestamp_seconds(pmod(id * 7919, 100000) * 13) AS at, pmod(id * 31, 101) * 0.5D AS price, id % 3 AS kind FROM range(900)")
    s = spark.sql("SELECT id, timestamp_seconds(pmod(id * 104729, 100000) * 13 - 50) AS day, pmod(id * 17, 101) * 0.5D AS price, id % 2 AS place FROM range(700)")
    given, condition = {"p": p, "s": s}, "p.at >= s.day AND p.at < s.day + INTERVAL 3 DAY AND p.price > s.price"
    aggs = {"n": "count(*)", "t": "sum(p.id)"}
    ours = query_block(given, "p", joins=[Join("s", condition)], group_by=["place", "kind"], aggs=aggs)
    assert frames.rows_of(ours) == frames.rows_of(plain(given, "p", "s", condition, ["place", "kind"], aggs)) != []


def test_more_pairs_than_could_be_made(spark, no_pairs):
    p = spark.range(200_000).selectExpr("id", "id % 4 AS v", "cast(id AS double) AS price", "id % 2 AS kind")
    s = spark.range(200_000).selectExpr("id", "id % 4 AS low", "id % 4 + 1 AS high", "-1D AS price")
    condition = "p.v >= s.low AND p.v < s.high AND p.price > s.price"
    ours = query_block({"p": p, "s": s}, "p", joins=[Join("s", condition)], group_by="kind", aggs={"n": "count(*)", "t": "sum(p.v)"})
    assert frames.rows_of(ours) == [(0, 2 * 50_000**2, 2 * 50_000**2), (1, 2 * 50_000**2, 4 * 50_000**2)]


def test_later_clauses_and_earlier_joins(spark, no_pairs):
    given, condition = tables(spark), "p.v BETWEEN s.low AND s.high"
    given["k"] = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "three")], "kind string, name string")
    first = Join("k", "p.kind = k.kind")
    ours = query_block(
        given, "p", joins=[first, Join("s", condition)], where=["s.id % 2 = 0"], group_by=["k.name", "s.place"], aggs=AGGS, having="k.name <> 'one' AND n > 3"
    )
    joined = given["p"].alias("p").join(given["k"].alias("k"), F.expr(first.condition)).join(given["s"].alias("s"), F.expr(condition))
    want = joined.filter("s.id % 2 = 0").groupBy("k.name", "s.place").agg(*[F.expr(t).alias(n) for n, t in AGGS.items()])
    assert frames.rows_of(ours) == frames.rows_of(want.filter("name <> 'one' AND n > 3")) != []
    early = query_block(given, "p", joins=[Join("s", condition)], group_by="place", aggs=AGGS, combine_early="p")
    assert frames.rows_of(early) == frames.rows_of(plain(given, "p", "s", condition, ["place"], AGGS)) != []


@pytest.mark.parametrize(
    "condition, keys, aggs",
    [
        ("p.v BETWEEN s.low AND s.high AND p.price > s.price AND p.id > s.id", ["kind"], {"n": "count(*)"}),
        ("p.v BETWEEN s.low AND s.high AND p.id <> s.id", ["kind"], {"n": "count(*)"}),
        ("p.v >= s.low AND p.v + 1 < s.high", ["kind"], {"n": "count(*)"}),
        ("p.v BETWEEN s.low AND s.high", ["kind"], {"t": "sum(p.w * s.id)"}),
        ("p.v BETWEEN s.low AND s.high", ["kind"], {"d": "count(DISTINCT p.w)"}),
        ("p.v BETWEEN s.low AND s.high", ["p.id % 2 + s.id % 2"], {"n": "count(*)"}),
        ("p.v BETWEEN s.low AND s.high", ["place"], {"n": "count(*)", "k": "concat(place, count(*))"}),
    ],
)
def test_any_other_block_still_makes_its_pairs(spark, condition, keys, aggs):
    given, keys = tables(spark, 60, 30), [F.expr(k) for k in keys]
    assert range_totals.join_totals(given["p"].alias("p"), given["s"].alias("s"), Join("s", condition), (), keys, aggs) is None
    ours = query_block(given, "p", joins=[Join("s", condition)], group_by=keys, aggs=aggs)
    assert frames.rows_of(ours) == frames.rows_of(plain(given, "p", "s", condition, keys, aggs)) != []


def test_keys_of_so_many_values_that_pairs_are_fewer(spark, monkeypatch):
    monkeypatch.setattr(range_totals, "ROWS", 0)
    given, condition = tables(spark), "p.v BETWEEN s.low AND s.high AND p.price > s.price"
    inputs = (given["p"].alias("p"), given["s"].alias("s"), Join("s", condition), (), ["p.id"])
    assert range_totals.join_totals(*inputs, {"t": "sum(p.w)"}) is None
    ours = query_block(given, "p", joins=[Join("s", condition)], group_by="p.id", aggs={"t": "sum(p.w)"})
    assert frames.rows_of(ours) == frames.rows_of(plain(given, "p", "s", condition, ["p.id"], {"t": "sum(p.w)"})) != []


def test_empty_sides(spark, no_pairs):
    given, condition = tables(spark, 20, 10), "p.v BETWEEN s.low AND s.high AND p.price > s.price"
    for name in "ps":
        some = {**given, name: given[name].filter("id < 0")}
        assert query_block(some, "p", joins=[Join("s", condition)], group_by="kind", aggs=AGGS).collect() == []
