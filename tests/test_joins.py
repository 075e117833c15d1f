"""Every join type gives the rows of Spark's own join, on frames with NULL and unmatched keys."""

import pytest
from pyspark.sql import functions as F

from blockquery.operators.joins import Join, join_on, unique_joins
from tests import frames

CONDITION = "emp.department_id = dept.id"


@pytest.mark.parametrize("condition", [CONDITION, CONDITION + " AND dept.name <> 'ops b'", "emp.department_id < dept.id"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_same_as_plain_join(spark, how, condition):
    emp, dept = frames.emp(spark).alias("emp"), frames.dept(spark).alias("dept")
    expected = frames.rows_of(emp.join(dept, F.expr(condition), how))
    small_emp, small_dept = (frames.of_known_size(spark, df).alias(n) for df, n in ((emp, "emp"), (dept, "dept")))
    if not (how == "full" and "<" in condition and "<>" not in condition):
        assert frames.rows_of(join_on(small_emp, small_dept, condition, how)) == expected
    if "emp.department_id <" in condition:
        with pytest.raises(ValueError, match="no equality"):
            join_on(emp, dept, condition, how)
        return
    assert frames.rows_of(join_on(emp, dept, condition, how)) == expected
    if how == "left":
        assert frames.rows_of(join_on(emp, dept, condition, how, hot_right=True)) == expected


def test_cross_join_is_an_inner_join_on_its_condition(spark):
    emp, dept = frames.emp(spark).alias("emp"), frames.dept(spark).alias("dept")
    crossed = join_on(emp, dept, CONDITION, "cross")
    assert frames.rows_of(crossed) == frames.rows_of(emp.join(dept, F.expr(CONDITION)))
    assert "CartesianProduct" not in crossed._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["right", "full", "left_anti", "left_semi"])
def test_qualified_names_resolve_after_the_join(spark, how):
    emp, dept = frames.emp(spark).alias("emp"), frames.dept(spark).alias("dept")
    joined = join_on(emp, dept, CONDITION, how)
    names = ["emp.name"] if how.startswith("left_") else ["emp.name", "dept.name"]
    expected = emp.join(dept, F.expr(CONDITION), how).select(*names)
    assert frames.rows_of(joined.select(*names)) == frames.rows_of(expected)


def test_second_outer_join_reads_columns_of_the_first(spark):
    emp, dept = frames.emp(spark).alias("emp"), frames.dept(spark).alias("dept")
    site = spark.createDataFrame([("ops", "hill"), ("sales", "lake"), ("none", "moor")], "dept_name string, site string").alias("site")
    second = "dept.name = site.dept_name"
    for how in ("right", "full"):
        ours = join_on(join_on(emp, dept, CONDITION, how), site, second, how)
        plain = emp.join(dept, F.expr(CONDITION), how).join(site, F.expr(second), how)
        assert frames.rows_of(ours) == frames.rows_of(plain)


def test_unique_joins_keep_the_first_of_each_in_order():
    a, b = Join("t", "c", "left"), Join("u", "c")
    assert unique_joins([a, b, Join("t", "c", "LEFT OUTER")]) == [a, b]
    assert unique_joins([a, b, Join("t", "c", "LEFT OUTER"), b, Join("t", "c")]) == [a, b, Join("t", "c")]


def test_condition_may_spell_names_in_any_case(spark):
    emp, dept = frames.emp(spark).alias("emp"), frames.dept(spark).alias("dept")
    for how in ("left_semi", "left_anti", "full"):
        ours = join_on(emp, dept, "EMP.Department_ID = dept.ID", how)
        assert frames.rows_of(ours) == frames.rows_of(emp.join(dept, F.expr(CONDITION), how))


def _count(df, node):
    return df._jdf.queryExecution().optimizedPlan().toString().count(node)


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_reads_grow_by_a_constant_per_outer_join(spark, how, tmp_path):
    frames.emp(spark).write.parquet(str(tmp_path / "emp"))
    emp = spark.read.parquet(str(tmp_path / "emp"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, reads = emp.alias("t0"), []
        for i in range(1, 4):
            df = join_on(df, emp.alias(f"t{i}"), f"t{i - 1}.name = t{i}.name", how, aliases=([f"t{k}" for k in range(i)], [f"t{i}"]))
            reads.append(_count(df, "parquet") + _count(df, "LogicalRDD"))
        assert reads[1] == reads[2] <= reads[0] + 1
        plain = emp.alias("t0")
        for i in range(1, 4):
            plain = plain.join(emp.alias(f"t{i}"), F.expr(f"t{i - 1}.name = t{i}.name"), how)
        assert frames.rows_of(df) == frames.rows_of(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_columns_of_the_named_side_are_kept_for_the_reduction(spark):
    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, customer_id long").alias("orders")
    customers = spark.createDataFrame([(7, "a"), (9, "b")], "id long, name string").alias("customers")
    on = "orders.customer_id = customers.id AND customers.name <> 'orders.id'"
    right = join_on(orders, customers, on, "right", aliases=(["orders"], ["customers"]))
    assert frames.rows_of(right) == frames.rows_of(orders.join(customers, F.expr(on), "right"))
    plan = right._jdf.queryExecution().optimizedPlan().toString()
    (kept,) = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert "customer_id" in kept and " id#" not in kept
