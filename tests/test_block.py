import itertools

import pytest
from pyspark.sql import functions as F

from blockquery import Join, catalog_tables, query_block
from tests import frames

CLAUSES = {
    "select": ["emp.name", "dept.name"],
    "joins": [Join("dept", "emp.department_id = dept.id", "left")],
    "where": ["emp.name <> 'bob'", "emp.name <> 'bob'", "emp.department_id >= 1"],
    "with_columns": {"twice": "emp.department_id * 2"},
}


@pytest.fixture
def tables(spark):
    return {"emp": frames.emp(spark), "dept": frames.dept(spark), "people": frames.people(spark), "spaced": frames.spaced(spark)}


def test_order_of_clauses_does_not_matter(tables):
    results = {
        str(frames.rows_of(query_block(tables, **dict(order)))) for order in itertools.permutations(CLAUSES.items())
    }
    assert len(results) == 1
    assert "('ann', 'sales', 2)" in results.pop()


def test_grouped_block_ignores_the_select_list(tables):
    out = query_block(
        tables,
        select=["emp.name", "dept.name"],
        joins=[Join("dept", "emp.department_id = dept.id")],
        group_by="emp.name",
        aggs={"n": "count(*)"},
        having=["count(*) > 1", "n < 9"],
    )
    assert out.columns == ["name", "n"]
    assert frames.rows_of(out) == [("ann", 2), ("bob", 2), ("cy", 2)]


def test_windows_and_derived_columns_are_appended(tables):
    out = query_block(
        tables,
        "people",
        select=["name"],
        windows={"rn": "row_number() OVER (PARTITION BY name ORDER BY age)"},
        with_columns={"next_age": F.col("age") + 1, "double_rn": "rn * 2"},
        where="name = 'bob'",
    )
    assert out.columns == ["name", "rn", "next_age", "double_rn"]
    assert frames.rows_of(out) == [("bob", 1, 32, 2), ("bob", 2, 32, 4)]


def test_derived_column_that_is_also_selected_comes_once(tables):
    out = query_block(tables, "people", select=["age", "name"], with_columns={"age": "age * 10"}, where="name = 'ann'")
    assert out.columns == ["age", "name"] and frames.rows_of(out) == [(300, "ann")]


def test_order_by_a_column_outside_the_select_list(tables):
    out = query_block(tables, "people", select=["name"], where="age > 12", order_by=["age DESC", "name"], limit=2)
    assert [r.name for r in out.collect()] == [None, "bob"]


def test_distinct_then_limit(tables):
    out = query_block(tables, "people", select=["name", "age"], distinct=True, order_by="age DESC NULLS LAST", limit=3)
    assert [r.age for r in out.collect()] == [40, 31, 30]


def test_renames(tables):
    out = query_block(tables, "people", renames={"name": "who", "absent": "x"}, where="age = 30")
    assert out.columns == ["who", "age"] and frames.rows_of(out) == [("ann", 30)]


def test_names_with_blanks_and_dots(tables):
    out = query_block(tables, "spaced", select=["spaced.ship via port", "`a.b`"], order_by="ship via port DESC")
    assert [tuple(r) for r in out.collect()] == [("up", 1), ("down", 2)]
    grouped = query_block(tables, "spaced", group_by="ship via port", aggs={"n": "sum(`a.b`)"})
    assert frames.rows_of(grouped) == [("down", 2), ("up", 1)]


def test_ambiguous_name_is_an_error(tables):
    with pytest.raises(Exception, match="AMBIGUOUS"):
        query_block(tables, "emp", joins=[Join("dept", "emp.department_id = dept.id")], select=["name"])


def test_errors(tables):
    with pytest.raises(ValueError):
        query_block(tables, "emp", having="n > 1")
    with pytest.raises(ValueError):
        query_block(tables, "emp", group_by="name")
    with pytest.raises(ValueError):
        query_block(tables, select=["name"])


def test_catalog_tables_with_and_without_namespace(spark):
    frames.people(spark).createOrReplaceTempView("people")
    frames.people(spark).createOrReplaceGlobalTempView("people")
    for lookup in (catalog_tables(spark), catalog_tables(spark, "global_temp")):
        assert query_block(lookup, "people", select=["people.name"], where="people.age = 12").first().name == "d  e"


def test_same_as_sql_text(spark, tables):
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    block = query_block(
        tables,
        "emp",
        joins=[Join("dept", "emp.department_id = dept.id", "left")],
        group_by="dept.name",
        aggs={"n": "count(*)", "last": "max(emp.name)"},
        having="count(*) > 1",
        order_by="n DESC",
    )
    text = """SELECT dept.name, count(*) AS n, max(emp.name) AS last FROM emp LEFT JOIN dept ON emp.department_id = dept.id
              GROUP BY dept.name HAVING count(*) > 1 ORDER BY n DESC"""
    assert frames.rows_of(block) == frames.rows_of(spark.sql(text))


def test_full_sort_spreads_ties_and_keeps_order(spark):
    many = spark.range(2000).select(F.lit("same").alias("k"), "id")
    out = query_block({"many": many}, "many", order_by="k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sizes = [r["n"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1000
    mixed = spark.range(500).select((F.col("id") % 5).alias("k"), "id")
    keys = [r.k for r in query_block({"m": mixed}, "m", order_by="k DESC").collect()]
    assert keys == sorted(keys, reverse=True)
