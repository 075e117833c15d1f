"""Aggregates combined below the join equal the plain block."""

import pytest

from blockquery.operators.joins import Join
from blockquery.plans.block import query_block
from blockquery.sources.tables import parquet_tables
from tests.test_plans import FOLDER, plan, settings  # noqa: F401  (a fixture)

AGGS = {
    "n": "count(*)",
    "ones": "count(1)",
    "counted": "count(v)",
    "total": "sum(sales.v)",
    "cents": "sum(cast(v AS decimal(10,2)))",
    "mean": "avg(v)",
    "lo": "min(v)",
    "hi": "max(v + 1)",
    "share": "round(sum(v) / count(*), 6)",
}


def tables(spark):
    sales = [(i % 7 if i % 11 else None, i % 3, None if i % 5 == 0 else i) for i in range(200)] + [(99, 1, 4), (None, None, None)]
    shops = [(k, f"s{k % 2}") for k in range(9)] + [(3, "again"), (None, "none")]
    return {
        "sales": spark.createDataFrame(sales, "k int, kind int, v int").selectExpr("*", "'x' AS unread"),
        "shops": spark.createDataFrame(shops, "k int, place string"),
        "open": spark.createDataFrame([("s0",), ("again",)], "name string"),
    }


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
@pytest.mark.parametrize("where", [(), ["sales.kind > 0"], ["sales.kind > 0 OR sales.kind IS NULL"]])
def test_equal_to_the_plain_block(spark, how, where):
    clauses = dict(joins=[Join("shops", "sales.k = shops.k", how)], where=where, aggs=AGGS)
    keys = ["kind"] if how in ("semi", "anti") else ["kind", "place"]
    plain, early = [query_block(tables(spark), "sales", group_by=keys, **clauses, combine_early=e) for e in (None, "sales")]
    assert plain.schema.simpleString() == early.schema.simpleString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, early.collect())) != []


def test_chain_with_the_table_last_and_having(spark):
    clauses = dict(
        joins=[Join("open", "shops.place = open.name", "left"), Join("sales", "sales.k = shops.k", "left")],
        group_by=["place", "open.name"],
        aggs=AGGS,
        having="n > 1",
    )
    plain, early = [query_block(tables(spark), "shops", **clauses, combine_early=e) for e in (None, "sales")]
    assert sorted(map(str, plain.collect())) == sorted(map(str, early.collect())) != []


@pytest.mark.parametrize("text", ["count(DISTINCT v)", "sum(v) FILTER (WHERE v > 3)", "sum(shops.k)", "median(v)", "sum(1)", "avg(cast(v AS decimal(9,2)))"])
def test_what_cannot_be_combined_is_refused(spark, text):
    with pytest.raises(ValueError):
        query_block(
            tables(spark), "sales", joins=[Join("shops", "sales.k = shops.k")], group_by="place", aggs={"x": text}, combine_early="sales"
        )


def test_the_aggregate_is_below_the_exchange_of_the_join(spark, settings):  # noqa: F811
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    block = query_block(
        parquet_tables(spark, FOLDER),
        "orders",
        joins=[Join("lineitem", "lineitem.l_orderkey = orders.o_orderkey")],
        group_by="o_orderpriority",
        aggs={"avg_qty": "avg(l_quantity)"},
        combine_early="lineitem",
    )
    text = plan(block)
    assert "partial_sum(l_quantity" in text[text.rindex("SortMergeJoin") :]
