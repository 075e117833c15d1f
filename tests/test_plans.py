"""Plans keep the shape that large tables need."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from blockquery.plans.registry import QUERIES
from blockquery.operators import windows as win
from blockquery.operators.joins import join_on
from blockquery.scripts import facts
from blockquery.scripts.sql_text import sql_text

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Settings for one test, put back afterwards."""
    changed = {}

    def change(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in changed.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_tasks_and_no_cartesian_product(spark, name):
    text = plan(spark_entry.queries()[name](spark, FOLDER))
    checkpointed = ("join_full_chain",)  # its first join is written once, and read as such
    for node in ("Python", "ArrowEval", "CartesianProduct", "MapInPandas", *([] if name in checkpointed else ["ExistingRDD"])):
        assert node not in text


def test_script_facts_do_not_shuffle(spark):
    scripts = spark.range(3).selectExpr("id AS script_id", "concat('val a = df.limit(', id, ')') AS content")
    chains = facts.chains(scripts)
    calls = facts.calls(chains)
    jobs = [facts.clean(scripts), chains, calls, facts.lineage(calls), facts.columns(calls), facts.predicates(calls)]
    for df in [*jobs, facts.unsupported(scripts), sql_text(chains)]:
        assert "Exchange" not in plan(df)


def test_generated_scripts_are_spread_before_they_grow(spark):
    text = plan(spark_entry.queries()["script_sql"](spark, FOLDER))
    assert text.count("Exchange") == 1 and "val a" not in "".join(text.split("Exchange")[1:])


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark_entry.queries()["filter_conjunction"](spark, FOLDER))
    for pushed in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_totalprice,200000.0)", "Not(EqualTo(o_orderpriority,5-LOW))"):
        assert pushed in text
    assert text.count("EqualTo(o_orderstatus,F)") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in text
    text = plan(spark_entry.queries()["join_inner"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_top_k_and_top_rows(spark):
    assert "TakeOrderedAndProject" in plan(spark_entry.queries()["top_k"](spark, FOLDER))
    text = plan(spark_entry.queries()["window_top_n"](spark, FOLDER))
    assert text.count("WindowGroupLimit") == 4  # before and after the shuffle of the parts of a key, and of the keys


def test_full_joins_of_large_sides_are_inner_and_anti_joins(spark):
    text = plan(spark_entry.queries()["join_full"](spark, FOLDER))
    assert "FullOuter" not in text and "Inner" in text and text.count("LeftAnti") >= 2


def test_semi_join_reduces_the_right_side_and_reuses_its_partitioning(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(spark_entry.queries()["join_semi"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("HashAggregate") == 2


def test_a_large_side_is_not_broadcast(spark, settings):
    settings(autoBroadcastJoinThreshold="1k")
    assert "SortMergeJoin" in plan(spark_entry.queries()["select_qualified"](spark, FOLDER))


def test_adaptive_execution_splits_hot_join_keys(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10k",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20k",
    )
    lines = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id").alias("f")
    keys = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("name")).alias("d")
    for how in ("inner", "left", "full"):
        joined = join_on(lines, keys, "f.k = d.k", how)
        assert joined.filter("id is not null").count() == 60_000
        out = joined.select("id", "name")
        assert len(out.collect()) == 60_000
        assert "skew=true" in plan(out)
    totals = win.partition_totals(lines, ["k"], {"n": F.count("*")})
    assert totals.agg(F.max("n")).first()[0] >= 20_000
    totals.collect()
    assert "skew=true" in plan(totals)
