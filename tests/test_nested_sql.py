"""Chains that need several blocks: running their text gives what the calls give one after the other."""

import pytest
from pyspark.sql import functions as F

from blockquery.scripts import facts
from blockquery.scripts.nested_sql import nested_sql_text
from tests import frames


def said(spark, *chains, **options):
    script = "\n".join(f"val v{i} = {c}" for i, c in enumerate(chains))
    found = nested_sql_text(facts.chains(spark.createDataFrame([(1, script)], "script_id int, content string")), **options)
    return [(r.blocks, r.sql_text) for r in found.orderBy("chain_no").collect()]


# the code of a chain -> what the same calls give
SHAPES = {
    't.select("a", "b").distinct().select("a")': lambda t, u: t.select("a", "b").distinct().select("a"),
    't.select("a").distinct().withColumn("a", expr("a % 2"))': lambda t, u: t.select("a").distinct().withColumn("a", F.expr("a % 2")),
    't.select("a", "b").withColumn("a", expr("a + 1")).withColumn("c", expr("a * 2"))': lambda t, u: t.select("a", "b")
    .withColumn("a", F.expr("a + 1"))
    .withColumn("c", F.expr("a * 2")),
    't.select("a").withColumn("a", expr("a + 1")).withColumn("a", expr("a * 2"))': lambda t, u: t.select("a").withColumn("a", F.expr("(a + 1) * 2")),
    't.withColumn("a", expr("a + 1")).orderBy("b, c")': lambda t, u: t.withColumn("a", F.expr("a + 1")),
    't.filter("a > 1").join("u", "t.a = u.a", "full")': lambda t, u: t.filter("a > 1").alias("t").join(u.alias("u"), F.expr("t.a = u.a"), "full"),
    't.filter("a > 1").join("u", "t.a = u.a", "right")': lambda t, u: t.filter("a > 1").alias("t").join(u.alias("u"), F.expr("t.a = u.a"), "right"),
    't.orderBy("b").groupBy("k").count()': lambda t, u: t.groupBy("k").count(),
    't.select("k", "a").withColumn("twice", expr("a * 2")).distinct()': lambda t, u: t.select("k", "a", F.expr("a * 2 AS twice")).distinct(),
    't.orderBy("a", "b", "c", "k").limit(3).filter("a > 0").select("b")': lambda t, u: t.orderBy("a", "b", "c", "k").limit(3).filter("a > 0").select("b"),
    't.groupBy("k").agg(sum("a").as("s")).groupBy("s").count().filter("count > 1")': lambda t, u: t.groupBy("k")
    .agg(F.sum("a").alias("s"))
    .groupBy("s")
    .count()
    .filter("count > 1"),
    't.groupBy("k").agg(max("a").as("a")).join("u", "t.a = u.a").select("t.k", "u.d")': lambda t, u: t.groupBy("k")
    .agg(F.max("a").alias("a"))
    .alias("t")
    .join(u.alias("u"), F.expr("t.a = u.a"))
    .select("t.k", "u.d"),
    't.withColumn("w", expr("a + b")).withColumn("a", expr("w + a")).filter("w > 1 AND a > 3").groupBy("w, a").count().limit(99).distinct()': lambda t, u: t.withColumn(
        "w", F.expr("a + b")
    )
    .withColumn("a", F.expr("w + a"))
    .filter("w > 1 AND a > 3")
    .groupBy("w", "a")
    .count(),
    't.withColumnRenamed("a", "z").select("z", "t.b").where("z >= 1")': lambda t, u: t.withColumnRenamed("a", "z").select("z", "b").where("z >= 1"),
    't.withColumn("w", expr("a")).select("a", "k").filter("a > 1")': lambda t, u: t.select("a", "k").filter("a > 1"),
}


def test_running_the_text_gives_what_the_calls_give(spark):
    rows = [(i % 4, (i * 7) % 5, i % 3, f"k{i % 2}") for i in range(24)] + [(None, 1, None, "k0"), (2, None, 1, None)]
    t = spark.createDataFrame(rows, "a int, b int, c int, k string")
    u = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w"), (None, "v")], "a int, d string")
    t.createOrReplaceTempView("t")
    u.createOrReplaceTempView("u")
    for (code, make), (blocks, text) in zip(SHAPES.items(), said(spark, *SHAPES), strict=True):
        assert text is not None, code
        ours, plain = spark.sql(text), make(t, u)
        assert sorted(ours.columns) == sorted(plain.columns), code
        if len(set(plain.columns)) == len(plain.columns):
            ours = ours.select(*plain.columns)
        assert frames.rows_of(ours) == frames.rows_of(plain), (code, text)


@pytest.mark.parametrize(
    "code,blocks",
    [
        ('t.limit(5).filter("x = 1").limit(2).filter("x = 2").limit(1)', 3),
        ('t.withColumn("a", expr("b")).withColumn("b", expr("a")).withColumn("a", expr("b + a"))', 3),
        ('t.filter("a = 1").select("a")', 1),
        ('t.groupBy("k").agg(sum("v").as("s")).filter("s > 2").groupBy("s").count().groupBy("count").count()', 3),
    ],
)
def test_number_of_blocks(spark, code, blocks):
    assert said(spark, code)[0][0] == blocks


@pytest.mark.parametrize(
    "code",
    [
        't.agg(sum("a"))',  # no group of its own
        't.groupBy("a")',
        't.limit(3).union("u")',
        't.limit(3).filter(col("a") > 1)',
        't.join("u", "t.a = u.a").limit(3).filter("u.a > 1")',  # u is inside the inner block
        't.limit(3).select("a"',
    ],
)
def test_what_has_no_text(spark, code):
    assert said(spark, code) == [(None, None)]


def test_text_of_one_block_is_the_text_of_the_chain(spark):
    from blockquery.scripts.sql_text import sql_text
    from tests.test_scripts import CASES

    script = "\n".join(f"val v{i} = {code}" for i, code in enumerate(CASES))
    chains = facts.chains(spark.createDataFrame([(1, script)], "script_id int, content string"))
    plain = {r.chain_no: r.sql_text for r in sql_text(chains).collect()}
    assert {r.chain_no: r.sql_text for r in nested_sql_text(chains).collect()} == plain


def test_namespace_and_given_base(spark):
    (found,) = said(spark, 'df.select("x").distinct().select("x")', namespace="lake.raw", base="s.t")
    assert found == (2, "SELECT x FROM (SELECT DISTINCT x FROM `lake`.`raw`.`s`.`t`) AS `t`")
