"""Facts and SQL texts of scripts, one case per behaviour."""

import pytest
from pyspark.sql import functions as F

from blockquery import Join, query_block
from blockquery.scripts import facts, rollups
from blockquery.scripts.sql_text import sql_text
from tests import frames


def corpus(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "script_id long, content string")


def texts(spark, content, **options):
    return [r.sql_text for r in sql_text(facts.chains(corpus(spark, content)), **options).orderBy("chain_no").collect()]


def reasons(spark, content):
    return [(r.chain_no, r.reason, r.op) for r in facts.unsupported(corpus(spark, content)).orderBy("chain_no", "reason", "op").collect()]


# code of one chain -> its SQL text
CASES = {
    'df.groupBy("id").count()': "SELECT id, count(*) AS count FROM `df` GROUP BY id",
    'df.select("name", "age")': "SELECT name, age FROM `df`",
    'df.select("name", "age").filter("age > 30")': "SELECT name, age FROM `df` WHERE age > 30",
    'df.filter("age > 30")': "SELECT * FROM `df` WHERE age > 30",
    'df.select("name", "age").orderBy("age DESC")': "SELECT name, age FROM `df` ORDER BY age DESC",
    'df.orderBy(asc("a"), desc("b"), "c d", "e f asc")': "SELECT * FROM `df` ORDER BY a ASC, b DESC, `c d`, `e f` ASC",
    'df.select("category").distinct()': "SELECT DISTINCT category FROM `df`",
    'df.select("timestamp", "message").limit(100)': "SELECT timestamp, message FROM `df` LIMIT 100",
    'df.filter("a = 1").limit(5).limit(7)': "SELECT * FROM `df` WHERE a = 1 LIMIT 5",
    'spark.read.table("sales")': "SELECT * FROM `sales`",
    'df.select("orders.id", "customers.name").join("customers", "orders.customer_id = customers.id")': (
        "SELECT orders.id, customers.name FROM `orders` INNER JOIN `customers` ON orders.customer_id = customers.id"
    ),
    'df.select("employees.name", "departments.name").join("departments", "employees.department_id = departments.id", "left")': (
        "SELECT employees.name, departments.name FROM `employees`"
        " LEFT OUTER JOIN `departments` ON employees.department_id = departments.id"
    ),
    'x.select("sales.date", "customers.name") .join("customers", "sales.customer_id = customers.id")'
    ' .groupBy("date") .agg(sum("amount").as("total_sales")) .orderBy(desc("total_sales")) .limit(10)': (
        "SELECT date, sum(amount) AS total_sales FROM `sales` INNER JOIN `customers` ON sales.customer_id = customers.id"
        " GROUP BY date ORDER BY total_sales DESC LIMIT 10"
    ),
    'df.join("a", "df.x = a.x").join("a", "df.x = a.x").join("b", "df.y >= b.y", "leftanti")': (
        "SELECT * FROM `df` INNER JOIN `a` ON df.x = a.x LEFT ANTI JOIN `b` ON df.y >= b.y"
    ),
    'df.where("a = 1 OR b = 2").filter("c = 3").filter("c = 3")': "SELECT * FROM `df` WHERE (a = 1 OR b = 2) AND (c = 3)",
    'df.filter("url = \'http://x  y\'")': "SELECT * FROM `df` WHERE url = 'http://x  y'",
    'df.groupBy("a,b c").agg(count("*").as("n"), max("net price"), avg("t.v").as("mean v"))': (
        "SELECT a, `b c`, count(*) AS n, max(`net price`), avg(t.v) AS `mean v` FROM `df` GROUP BY a, `b c`"
    ),
    'df.filter("a > 1").groupBy("k").agg(sum("v").as("s")).filter("s > 2").where("k < 9")': (
        "SELECT k, sum(v) AS s FROM `df` WHERE a > 1 GROUP BY k HAVING (s > 2) AND (k < 9)"
    ),
    'df.groupBy("k").agg(sum("v").as("s"), max("v").as("m")).select("m")': "SELECT max(v) AS m FROM `df` GROUP BY k",
    'df.select("a").withColumn("b", expr("(a + 1) * 2")).withColumn("c", col("a") + lit(3))': (
        "SELECT a, (a + 1) * 2 AS b, a + 3 AS c FROM `df`"
    ),
    'df.select("a", "b").withColumn("a", expr("a + 1"))': "SELECT a + 1 AS a, b FROM `df`",
    'df.select("t.a", "b c", "d").withColumnRenamed("a", "x").withColumnRenamed("b c", "y z").withColumnRenamed("no", "n")': (
        "SELECT t.a AS x, `b c` AS `y z`, d FROM `t`"
    ),
    'df.filter("y > 1").select("x", "y").withColumn("y", expr("y + 1")).filter("x > 1")': "SELECT x, y + 1 AS y FROM `df` WHERE (y > 1) AND (x > 1)",
    'df.limit(99999999999999999999)': "SELECT * FROM `df`",
    'df.select("a").withColumnRenamed("a", "b").withColumnRenamed("b", "c")': "SELECT a AS c FROM `df`",
    'df.withColumnRenamed("a", "b").withColumnRenamed("c d", "e")': "SELECT * EXCEPT (a, `c d`), a AS b, `c d` AS e FROM `df`",
    'df.groupBy("k").count().withColumnRenamed("count", "n")': "SELECT k, count(*) AS n FROM `df` GROUP BY k",
    'spark.read.table("shipments").select("ship via port", "pier")\n  .join("transactions", "shipments.cargo = transactions.cargo")\n'
    '  .groupBy("pier,ship via port").agg(count("pier").as("total")).orderBy(desc("total"))': (
        "SELECT pier, `ship via port`, count(pier) AS total FROM `shipments`"
        " INNER JOIN `transactions` ON shipments.cargo = transactions.cargo GROUP BY pier, `ship via port` ORDER BY total DESC"
    ),
}


def test_sql_texts(spark):
    script = "\n".join(f"val v{i} = {code}" for i, code in enumerate(CASES))
    assert texts(spark, script) == list(CASES.values())
    assert reasons(spark, script) == []


def test_namespace_and_given_base(spark):
    assert texts(spark, 'val a = df.select("x").join("u", "t.k = u.k")', namespace="lake.raw", base="t") == [
        "SELECT x FROM `lake`.`raw`.`t` INNER JOIN `lake`.`raw`.`u` ON t.k = u.k"
    ]


def test_comments_and_strings(spark):
    script = """// val a = spark.read.table("no")
val b = df.filter("u = 'http://x'") // val c = d.count()
/* val e = spark.read.table("no")
*/ val f = /* in between */ df.select("value") // end"""
    assert texts(spark, script) == ["SELECT * FROM `df` WHERE u = 'http://x'", "SELECT value FROM `df`"]


def test_chains_over_lines_and_dots_at_line_ends(spark):
    script = 'val a = spark\n  .read\n  .table("t").\n  select(\n    "x",\n    "y"\n  )\n\nval b = a . filter ( "x > 1" )'
    assert texts(spark, script) == ["SELECT x, y FROM `t`", "SELECT * FROM `a` WHERE x > 1"]


def test_typed_assignments(spark):
    script = 'val a: DataFrame = spark.read.table("t")\nlazy val b : Dataset[Row] = a.select("x")\nval n: Int = 3'
    assert texts(spark, script) == ["SELECT * FROM `t`", "SELECT x FROM `a`"]
    assert reasons(spark, script) == [(2, "no chain", None)]


# code -> findings as (chain_no, reason, op)
GAPS = {
    "val n = 42": [(0, "no chain", None)],
    "val n = 4.2": [(0, "no chain", None)],
    'val a = spark.read.table("t").union("u")': [(0, "unknown call", "union")],
    'val a = df.filter(col("x") > 1)': [(0, "unread arguments", "filter")],
    'val a = df.select("a"", "b")\nval b = df.select("c")': [(0, "unread arguments", "select")],
    'val a = df.select("a"': [(0, "unread arguments", "select")],
    "val a = df.map { x => x }": [(0, "unknown call", "map")],
    'val a = df.join("t", "a = b", "sideways")': [(0, "unread arguments", "join")],
    'val a = df.limit(5).filter("x > 1")': [(0, "order of calls", None)],
    "val a = df.count()": [(0, "order of calls", None)],
    'val a = df.groupBy("k").limit(3)': [(0, "order of calls", None)],
    'val a = df.groupBy("k").count().join("t", "k = j")': [(0, "order of calls", None)],
    'val a = df.distinct().groupBy("k").count()': [(0, "order of calls", None)],
    'val a = df.withColumn("y", expr("year(d)")).groupBy("y").count()': [(0, "order of calls", None)],
    'val a = df.withColumn("y", expr("x * 2")).filter("y > 1")': [(0, "order of calls", None)],
    'val a = df.select("a", "b").distinct().select("a")': [(0, "order of calls", None)],
    'val a = df.select("a").distinct().withColumn("a", expr("a % 2"))': [(0, "order of calls", None)],
    'val a = df.select("a", "b").withColumn("a", expr("a + 1")).withColumn("c", expr("a * 2"))': [(0, "order of calls", None)],
    'val a = df.select("a").withColumn("a", expr("a + 1")).withColumn("a", expr("a * 2"))': [(0, "order of calls", None)],
    'val a = df.withColumn("a", expr("a + 1"))': [(0, "order of calls", None)],
    'val a = df.filter("a > 1").join("t", "df.a = t.a", "full")': [(0, "order of calls", None)],
    'val a = df.filter("a > 1").join("t", "df.a = t.a", "right")': [(0, "order of calls", None)],
    'val a = df.orderBy("x").groupBy("k").count()': [(0, "order of calls", None)],
    'val a = df.select("k", "v").withColumn("t", expr("v * 2")).select("k")': [(0, "order of calls", None)],
    'val a = df.orderBy("a, b DESC")': [(0, "unread arguments", "orderBy")],
    'val a = df.withColumnRenamed("x", "y").join("t", "df.y = t.k")': [(0, "order of calls", None)],
    "val a = df.read [": [(0, "unread arguments", "read")],
}


@pytest.mark.parametrize("code", GAPS)
def test_gaps(spark, code):
    assert reasons(spark, code) == GAPS[code]
    assert texts(spark, code)[:1] in ([], [None])


def test_nesting_deeper_than_read_is_reported(spark):
    deep = 'df.withColumn("x", ' + "f(" * 9 + "1" + ")" * 9 + ")"
    assert reasons(spark, f"val a = {deep}") == [(0, "unread arguments", "withColumn")]
    fine = 'df.withColumn("x", ' + "f(" * 7 + "1" + ")" * 7 + ")"
    assert reasons(spark, f"val a = {fine}") == []


def test_very_long_texts(spark):
    columns = ", ".join(f'"column_{i}"' for i in range(20_000))
    script = f"/* {'x ' * 200_000} */ val a = df.select({columns}).withColumn(\"y\", {'(1) + ' * 20_000} 1).filter(\"{'a' * 300_000}\")"
    (text,) = texts(spark, script)
    assert text.startswith("SELECT column_0, column_1") and text.count("column_") == 20_000 and text.endswith("a" * 300_000)


def test_lineage_columns_predicates(spark):
    calls = facts.calls(
        facts.chains(
            corpus(spark, 'val a = spark.read.table("t").select("x", "y, z").join("u", "t.k = u.k", "RIGHT OUTER").where(" x > 1 ")')
        )
    )
    assert [tuple(r)[3:] for r in facts.lineage(calls).orderBy("step_no").collect()] == [
        ("from", "t", None, None),
        ("join", "u", "RIGHT OUTER", "t.k = u.k"),
    ]
    assert [r.name for r in facts.columns(calls).collect()] == ["x", "y", "z"]
    assert [r.predicate for r in facts.predicates(calls).collect()] == [" x > 1 "]


def test_rollups(spark):
    chains = facts.chains(
        corpus(
            spark,
            'val a = spark.read.table("t").join("u", "k").join("u", "k = k").join("w", "k = k")',
            'val b = spark.read.table("t").join("u", "k = k")\nval c = x.join("u", "k = k")',
        )
    )
    calls = facts.calls(chains)
    assert {r.op: r["count"] for r in rollups.op_counts(calls).collect()} == {"read": 2, "table": 2, "join": 5}
    assert {r.tbl: r["count"] for r in rollups.table_popularity(facts.lineage(calls)).collect()} == {"t": 2, "u": 4, "w": 1}
    assert frames.rows_of(rollups.join_pairs(chains)) == [("t", "u", 3), ("t", "w", 1)]


def test_sql_text_runs_and_equals_the_block(spark):
    tables = {"emp": frames.emp(spark), "dept": frames.dept(spark)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    script = (
        'val a = spark.read.table("emp").select("emp.name", "dept.name").join("dept", "emp.department_id = dept.id", "left")'
        '.filter("emp.name <> \'bob\'").groupBy("dept.name").agg(count("*").as("n"), max("emp.name").as("last"))'
        '.filter("n > 1").orderBy(desc("n"))\n'
        'val b = spark.read.table("emp").withColumnRenamed("name", "who").filter("department_id = 2").distinct()'
    )
    grouped, renamed = [spark.sql(t) for t in texts(spark, script)]
    block = query_block(
        tables,
        select=["emp.name", "dept.name"],
        joins=[Join("dept", "emp.department_id = dept.id", "left")],
        where="emp.name <> 'bob'",
        group_by="dept.name",
        aggs={"n": F.count("*"), "last": "max(emp.name)"},
        having="n > 1",
        order_by=[F.desc("n")],
    )
    assert frames.rows_of(grouped) == frames.rows_of(block)
    other = query_block(tables, "emp", renames={"name": "who"}, where="department_id = 2", distinct=True)
    assert frames.rows_of(renamed.select("who", "department_id")) == frames.rows_of(other)
