"""Registered queries of the relational layer, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.operators import frames
from blockquery.operators import windows as win
from blockquery.operators.joins import Join
from blockquery.operators.order_statistics import percentiles
from blockquery.plans.block import query_block
from blockquery.plans.registry import query
from blockquery.sources.tables import catalog_tables, parquet_tables

CUSTOMER_OF_ORDER = Join("customer", "orders.o_custkey = customer.c_custkey")
NATION_OF_CUSTOMER = Join("nation", "customer.c_nationkey = nation.n_nationkey")
REGION_OF_NATION = Join("region", "nation.n_regionkey = region.r_regionkey")

EXACT_SUM = "cast(sum(cast({} AS decimal(18,2))) AS double)"


# --- scans ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "lineitem", select=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    )


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_namespaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    parquet_tables(spark, sf_dir)("supplier").createOrReplaceGlobalTempView("supplier")
    return query_block(
        catalog_tables(spark, namespace="global_temp"), "supplier", select=["s_suppkey", "s_name", "supplier.s_nationkey"]
    )


@query("SELECT orders.o_orderkey, orders.o_orderstatus FROM orders")
def scan_inferred_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), select=["orders.o_orderkey", "orders.o_orderstatus"])


# --- projections ---------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "customer", select=["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "customer", select="c_custkey, c_name,c_mktsegment")


@query("SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey")
def select_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        joins=[CUSTOMER_OF_ORDER],
        select=["orders.o_orderkey", "customer.c_name"],
    )


@query("SELECT * FROM customer WHERE c_acctbal > 9000")
def select_star_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "customer", where="c_acctbal > 9000")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * l_quantity AS gross FROM lineitem")
def with_column_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        select=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        with_columns={"gross": "l_extendedprice * l_quantity"},
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS band FROM orders")
def with_column_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        select=["o_orderkey"],
        with_columns={"band": "CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END"},
    )


@query("SELECT p_partkey, p_size * 2 AS size2, p_retailprice + 10 AS price10 FROM part")
def with_columns_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        select=["p_partkey"],
        with_columns={"size2": "p_size * 2", "price10": "p_retailprice + 10"},
    )


@query("SELECT s_suppkey AS supplier_id, s_name, s_nationkey, s_acctbal FROM supplier")
def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "supplier", renames={"s_suppkey": "supplier_id"})


@query("SELECT p_partkey, p_name FROM part")
def rename_missing_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "part", select=["p_partkey", "p_name"], renames={"no_such_column": "other"}
    )


@query("SELECT c_custkey AS id, c_acctbal * 2 AS double_bal FROM customer")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        select=[F.col("c_custkey").alias("id"), F.expr("c_acctbal * 2").alias("double_bal")],
    )


@query('SELECT c_custkey AS "customer key", c_name AS "customer name" FROM customer')
def select_spaced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = parquet_tables(spark, sf_dir)("customer")
    spaced = customer.withColumnsRenamed({"c_custkey": "customer key", "c_name": "customer name"})
    return query_block({"customer": spaced}, "customer", select=["customer key", "customer.customer name"])


# --- filters -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30")
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        select=["l_orderkey", "l_linenumber", "l_quantity"],
        where="l_quantity > 30",
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def where_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "orders", select=["o_orderkey", "o_orderstatus"], where="o_orderstatus = 'F'"
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 AND o_orderpriority <> '5-LOW'")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        select=["o_orderkey"],
        where=["o_orderstatus = 'F'", "o_totalprice >= 200000", "o_orderpriority <> '5-LOW'", "o_orderstatus = 'F'"],
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "orders", group_by="o_custkey", aggs={"n": "count(*)"}, having="count(*) > 12"
    )


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2')")
def filter_between_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        select=["p_partkey", "p_size"],
        where="p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2')",
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "part", select=["p_partkey", "p_name"], where="p_name LIKE 'small%'"
    )


@query(
    "SELECT customer.c_custkey FROM customer LEFT JOIN nation"
    " ON customer.c_nationkey = nation.n_nationkey AND nation.n_regionkey = 0 WHERE nation.n_name IS NULL"
)
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("nation", f"{NATION_OF_CUSTOMER.condition} AND nation.n_regionkey = 0", "left")],
        where="nation.n_name IS NULL",
        select=["customer.c_custkey"],
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR NOT o_totalprice < 400000")
def filter_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        select=["o_orderkey"],
        where="o_orderstatus = 'F' OR NOT o_totalprice < 400000",
    )


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997")
def filter_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "orders", select=["o_orderkey"], where="year(o_orderdate) = 1997"
    )


# --- joins ---------------------------------------------------------------------------------------


@query(
    "SELECT orders.o_orderkey, customer.c_name FROM orders INNER JOIN customer"
    " ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'BUILDING'"
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        joins=[CUSTOMER_OF_ORDER],
        where="customer.c_mktsegment = 'BUILDING'",
        select=["orders.o_orderkey", "customer.c_name"],
    )


@query(
    "SELECT customer.c_custkey, nation.n_name FROM customer LEFT JOIN nation"
    " ON customer.c_nationkey = nation.n_nationkey AND nation.n_regionkey = 0"
)
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("nation", f"{NATION_OF_CUSTOMER.condition} AND nation.n_regionkey = 0", "left")],
        select=["customer.c_custkey", "nation.n_name"],
    )


@query(
    "SELECT customer.c_custkey, orders.o_orderkey FROM customer"
    " LEFT JOIN orders ON customer.c_custkey = orders.o_custkey AND orders.o_totalprice > 400000"
)
def join_left_hot_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("orders", "customer.c_custkey = orders.o_custkey AND orders.o_totalprice > 400000", "left", hot_right=True)],
        select=["customer.c_custkey", "orders.o_orderkey"],
    )


@query("SELECT events.event_id, customer.c_custkey FROM events RIGHT JOIN customer ON events.user_id = customer.c_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "events",
        joins=[Join("customer", "events.user_id = customer.c_custkey", "right")],
        select=["events.event_id", "customer.c_custkey"],
    )


BIG_ORDERS_OF_CUSTOMER = "customer.c_custkey = orders.o_custkey AND orders.o_totalprice > 400000"


@query(f"SELECT customer.c_custkey, orders.o_orderkey FROM customer FULL JOIN orders ON {BIG_ORDERS_OF_CUSTOMER}")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("orders", BIG_ORDERS_OF_CUSTOMER, "full")],
        select=["customer.c_custkey", "orders.o_orderkey"],
    )


@query(
    "SELECT customer.c_custkey, orders.o_orderkey, labels.doc_id, documents.source FROM customer"
    f" FULL JOIN orders ON {BIG_ORDERS_OF_CUSTOMER} FULL JOIN labels ON customer.c_custkey = labels.doc_id"
    " FULL JOIN documents ON labels.doc_id = documents.doc_id"
)
def join_full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[
            Join("orders", BIG_ORDERS_OF_CUSTOMER, "full"),
            Join("labels", "customer.c_custkey = labels.doc_id", "full"),
            Join("documents", "labels.doc_id = documents.doc_id", "full"),
        ],
        select=["customer.c_custkey", "orders.o_orderkey", "labels.doc_id", "documents.source"],
    )


@query(
    "SELECT customer.c_custkey FROM customer SEMI JOIN events"
    " ON customer.c_custkey = events.user_id"
)
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("events", "customer.c_custkey = events.user_id", "semi")],
        select=["customer.c_custkey"],
    )


@query(
    "SELECT customer.c_custkey FROM customer ANTI JOIN events"
    " ON customer.c_custkey = events.user_id"
)
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("events", "customer.c_custkey = events.user_id", "anti")],
        select=["customer.c_custkey"],
    )


@query(
    "SELECT customer.c_custkey, nation.n_name FROM customer CROSS JOIN nation"
    " WHERE customer.c_nationkey = nation.n_nationkey"
)
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("nation", NATION_OF_CUSTOMER.condition, "cross")],
        select=["customer.c_custkey", "nation.n_name"],
    )


@query(
    "SELECT customer.c_custkey, nation.n_name, region.r_name FROM customer"
    " JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey"
)
def join_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[NATION_OF_CUSTOMER, REGION_OF_NATION],
        select=["customer.c_custkey", "nation.n_name", "region.r_name"],
    )


@query(
    "SELECT customer.c_custkey, region.r_name FROM customer JOIN region"
    " ON customer.c_nationkey < region.r_regionkey * 5"
)
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("region", "customer.c_nationkey < region.r_regionkey * 5")],
        select=["customer.c_custkey", "region.r_name"],
    )


@query(
    "SELECT o_orderpriority, l_returnflag, count(*) AS pairs, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity"
    " FROM lineitem JOIN orders ON lineitem.l_shipdate >= orders.o_orderdate AND lineitem.l_shipdate < orders.o_orderdate + INTERVAL 2 DAY"
    " AND lineitem.l_extendedprice > orders.o_totalprice GROUP BY o_orderpriority, l_returnflag"
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within two days of orders that cost less, of whatever order they are; both sides may be of any size."""
    within = "lineitem.l_shipdate >= orders.o_orderdate AND lineitem.l_shipdate < orders.o_orderdate + INTERVAL 2 DAY"
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        joins=[Join("orders", f"{within} AND lineitem.l_extendedprice > orders.o_totalprice")],
        group_by=["o_orderpriority", "l_returnflag"],
        aggs={"pairs": "count(*)", "quantity": EXACT_SUM.format("l_quantity")},
    )


@query(
    "SELECT lineitem.l_orderkey, lineitem.l_linenumber, lineitem.l_partkey, orders.o_custkey FROM lineitem JOIN orders"
    " ON lineitem.l_orderkey = orders.o_orderkey AND lineitem.l_shipdate > orders.o_orderdate"
)
def join_equi_plus_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        joins=[Join("orders", "lineitem.l_orderkey = orders.o_orderkey AND lineitem.l_shipdate > orders.o_orderdate")],
        select=["lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey", "orders.o_custkey"],
    )


@query(
    "SELECT customer.c_custkey, nation.n_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey"
)
def join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[NATION_OF_CUSTOMER, Join("nation", NATION_OF_CUSTOMER.condition, "INNER JOIN")],
        select=["customer.c_custkey", "nation.n_name"],
    )


@query(
    "SELECT customer.c_custkey, nation.n_name FROM customer"
    " LEFT OUTER JOIN nation ON customer.c_nationkey = nation.n_nationkey AND nation.n_regionkey = 1"
)
def join_type_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("nation", f"{NATION_OF_CUSTOMER.condition} AND nation.n_regionkey = 1", "Left Outer Join")],
        select=["customer.c_custkey", "nation.n_name"],
    )


# --- aggregations --------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "orders", group_by="o_orderstatus", aggs={"count": "count(*)"}
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_count_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        group_by=["o_orderstatus", "o_orderpriority"],
        aggs={"count": "count(*)"},
    )


@query(f"SELECT l_returnflag, {EXACT_SUM.format('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        group_by="l_returnflag",
        aggs={"total": EXACT_SUM.format("l_extendedprice")},
    )


@query("SELECT l_returnflag, avg(l_quantity) AS avg_qty FROM lineitem GROUP BY l_returnflag")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "lineitem", group_by="l_returnflag", aggs={"avg_qty": "avg(l_quantity)"}
    )


@query("SELECT event_type, count(value) AS n FROM events GROUP BY event_type")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "events", group_by="event_type", aggs={"n": "count(value)"})


@query("SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        group_by="p_brand",
        aggs={"lo": "min(p_retailprice)", "hi": "max(p_retailprice)"},
    )


@query("SELECT p_brand, round(stddev(p_retailprice), 4) AS sd FROM part GROUP BY p_brand")
def agg_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "part", group_by="p_brand", aggs={"sd": "round(stddev(p_retailprice), 4)"}
    )


@query(
    "SELECT event_type, round(median(value), 4) AS mid, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY event_type"
)
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few event types hold all rows; no task holds the values of one."""
    found = percentiles(parquet_tables(spark, sf_dir)("events"), ["event_type"], "value", {"mid": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("mid", 4).alias("mid"), F.round("p90", 4).alias("p90"))


@query("SELECT round(median(l_extendedprice), 4) AS mid, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def agg_median_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(parquet_tables(spark, sf_dir)("lineitem"), [], "l_extendedprice", {"mid": 0.5, "lo": 0, "hi": 1})
    return found.select(F.round("mid", 4).alias("mid"), "lo", "hi")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "events", group_by="event_type", aggs={"n": F.count("*")})


@query(
    "SELECT l_returnflag, l_linestatus, cast(sum(l_linenumber) AS bigint) AS s FROM lineitem"
    " GROUP BY l_returnflag, l_linestatus"
)
def group_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "lineitem",
        group_by=["l_returnflag", "l_linestatus"],
        aggs={"s": "sum(l_linenumber)"},
    )


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY p_brand, p_type, p_size")
def group_packed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir), "part", group_by="p_brand,p_type, p_size", aggs={"n": "count(*)"}
    )


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "orders", select=["o_orderpriority"], distinct=True)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "events", select=["user_id", "event_type"], distinct=True)


@query(
    "SELECT p_brand, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi, avg(p_size) AS mean FROM part GROUP BY p_brand"
)
def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        group_by="p_brand",
        aggs={"n": "count(*)", "lo": "min(p_size)", "hi": "max(p_size)", "mean": "avg(p_size)"},
    )


@query(
    "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " GROUP BY n_name ORDER BY n DESC, n_name"
)
def join_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        joins=[Join("nation", "c_nationkey = n_nationkey")],
        group_by="n_name",
        aggs={"n": "count(*)"},
        order_by=["n DESC", "n_name"],
    )


# --- windows -------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint)"
    " AS rn FROM orders"
)
def window_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = query_block(parquet_tables(spark, sf_dir), "orders", select=["o_orderkey", "o_custkey", "o_totalprice"])
    return win.row_numbers(orders, ["o_custkey"], ["o_totalprice desc", "o_orderkey"], "rn").select("o_orderkey", "rn")


@query(
    "SELECT p_partkey, cast(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS rk,"
    " cast(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS dr FROM part"
)
def window_rank_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = query_block(parquet_tables(spark, sf_dir), "part", select=["p_partkey", "p_brand", "p_size"])
    return win.ranks(part, ["p_brand"], "p_size", rank="rk", dense_rank="dr").select("p_partkey", "rk", "dr")


@query(
    "SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderdate) AS bigint) AS rk,"
    " cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderdate) AS bigint) AS dr FROM orders"
)
def window_rank_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = query_block(parquet_tables(spark, sf_dir), "orders", select="o_orderkey, o_custkey, o_orderstatus, o_orderdate")
    ranked = win.ranks(orders, ["o_custkey"], ["o_orderstatus DESC", "o_orderdate"], rank="rk", dense_rank="dr")
    return ranked.select("o_orderkey", "rk", "dr")


@query(
    "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bigint)"
    " AS quartile FROM customer"
)
def window_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = query_block(
        parquet_tables(spark, sf_dir), "customer", select=["c_custkey", "c_mktsegment", "c_acctbal"]
    )
    return win.ntiles(customer, ["c_mktsegment"], ["c_acctbal", "c_custkey"], 4, "quartile").select("c_custkey", "quartile")


@query(
    "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,"
    " lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events"
)
def window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = query_block(parquet_tables(spark, sf_dir), "events", select=["event_id", "user_id", "ts", "value"])
    columns = {
        "prev_value": lambda w: F.lag("value").over(w),
        "next_value": lambda w: F.lead("value").over(w),
    }
    out = win.neighbours(events, ["user_id"], ["ts", "event_id"], columns, before=1, after=1)
    return out.select("event_id", *columns)


@query(
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key FROM orders"
    " WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
def window_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = query_block(parquet_tables(spark, sf_dir), "orders", select=["o_orderkey", "o_custkey", "o_orderdate"])
    ends = win.first_last(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"first_key": "o_orderkey"}, {"last_key": "o_orderkey"}
    )
    return ends.select("o_orderkey", "first_key", "last_key")


@query(
    "SELECT event_id, cast(sum(cast(value AS decimal(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS running FROM events"
)
def window_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = query_block(parquet_tables(spark, sf_dir), "events", select=["event_id", "user_id", "ts", "value"])
    exact = F.expr("cast(value AS decimal(18,2))")
    out = win.running(events, ["user_id"], ["ts", "event_id"], {"running": ("sum", exact)})
    return out.select("event_id", F.col("running").cast("double").alias("running"))


@query(
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg3 FROM events"
)
def window_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = query_block(parquet_tables(spark, sf_dir), "events", select=["event_id", "user_id", "ts", "value"])
    columns = {"avg3": lambda w: F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4)}
    return win.neighbours(events, ["user_id"], ["ts", "event_id"], columns, before=2).select("event_id", "avg3")


@query(
    "SELECT o_orderkey, round(o_totalprice /"
    " cast(sum(cast(o_totalprice AS decimal(18,2))) OVER (PARTITION BY o_custkey) AS double), 6) AS share FROM orders"
)
def window_partition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = query_block(parquet_tables(spark, sf_dir), "orders", select=["o_orderkey", "o_custkey", "o_totalprice"])
    totals = win.partition_totals(orders, ["o_custkey"], {"total": F.expr(EXACT_SUM.format("o_totalprice"))})
    return totals.select("o_orderkey", F.expr("round(o_totalprice / total, 6)").alias("share"))


@query(
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3"
)
def window_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = query_block(parquet_tables(spark, sf_dir), "orders", select=["o_orderkey", "o_custkey", "o_totalprice"])
    top = win.top_rows(orders, ["o_custkey"], ["o_totalprice desc", "o_orderkey"], 3)
    return top.select("o_custkey", "o_orderkey")


@query(
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total,"
    " row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, ntile(10) OVER (ORDER BY o_orderdate, o_orderkey) AS tenth FROM orders"
)
def window_without_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total, position and tile over the whole table, which is cut into ordered chunks where it is large."""
    orders = parquet_tables(spark, sf_dir)("orders").select("o_orderkey", "o_orderdate", F.expr("cast(o_totalprice AS decimal(18,2))").alias("price"))
    order = ["o_orderdate", "o_orderkey"]
    found = win.running(orders, [], order, {"running_total": ("sum", "price"), "place": ("count", F.lit(1))})
    found = win.ntiles(found, [], order, 10, "tenth")
    return found.select("o_orderkey", F.col("running_total").cast("double").alias("running_total"), "place", "tenth")


@query(
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS near_total, count(*) OVER w AS near_orders"
    " FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)"
    " WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN 30 PRECEDING AND 7 FOLLOWING)"
)
def window_value_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the same priority from thirty days before to a week after each order."""
    orders = parquet_tables(spark, sf_dir)("orders").select(
        "o_orderkey", "o_orderpriority", F.expr("unix_date(cast(o_orderdate AS date))").alias("day"), F.expr("cast(o_totalprice AS decimal(18,2))").alias("price")
    )
    columns = {"near_total": ("sum", "price"), "near_orders": ("count", F.lit(1))}
    found = frames.value_frames(orders, ["o_orderpriority"], "day", columns, before=30, after=7)
    return found.select("o_orderkey", F.col("near_total").cast("double").alias("near_total"), "near_orders")


# --- sorts and limits ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def order_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        select=["o_orderkey", "o_totalprice"],
        order_by=["desc(o_totalprice)", F.desc("o_orderkey")],
        limit=100,
    )


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC, c_custkey DESC LIMIT 100")
def order_text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "customer",
        select=["c_custkey", "c_acctbal"],
        order_by=["c_acctbal ASC", "c_custkey DESC"],
        limit=100,
    )


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey DESC LIMIT 100")
def order_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        select="p_partkey, p_brand, p_size",
        order_by="p_size DESC, p_brand, desc(p_partkey)",
        limit=100,
    )


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 100")
def order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        select=["p_partkey", "p_brand", "p_size"],
        order_by=["p_brand", "p_size DESC", "p_partkey"],
        limit=100,
    )


@query("SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 100) t")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(parquet_tables(spark, sf_dir), "events", limit=100).agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "events",
        select=["event_id", "value"],
        order_by=["value DESC", "event_id"],
        limit=10,
    )


# --- whole blocks --------------------------------------------------------------------------------


@query(
    "SELECT event_id, cast(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS bigint) AS place,"
    " cast(count(*) OVER (PARTITION BY event_type ORDER BY user_id) AS bigint) AS upto_user,"
    " lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events"
)
def block_window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few event types hold all rows: beyond ``hot_rows`` of one, its windows are split."""
    return query_block(
        parquet_tables(spark, sf_dir),
        "events",
        windows={
            "place": "cast(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS bigint)",
            "upto_user": "count(*) OVER (PARTITION BY event_type ORDER BY user_id)",
            "before": "lag(event_id) OVER (PARTITION BY events.event_type ORDER BY events.ts, events.event_id)",
        },
        select=["event_id"],
    )


@query(
    "SELECT DISTINCT r_name AS region_name, n_name, n,"
    " cast(rank() OVER (PARTITION BY r_name ORDER BY n DESC) AS bigint) AS rk, n * 2 AS n2"
    " FROM (SELECT region.r_name, nation.n_name, count(*) AS n FROM orders"
    " JOIN customer ON orders.o_custkey = customer.c_custkey JOIN nation ON customer.c_nationkey = nation.n_nationkey"
    " JOIN region ON nation.n_regionkey = region.r_regionkey WHERE orders.o_orderstatus = 'F'"
    " GROUP BY region.r_name, nation.n_name HAVING count(*) > 10) t ORDER BY n DESC, n_name LIMIT 10"
)
def block_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        limit=10,
        order_by=["n DESC", "n_name"],
        distinct=True,
        renames={"r_name": "region_name"},
        with_columns={"n2": "n * 2"},
        windows={"rk": "cast(rank() OVER (PARTITION BY r_name ORDER BY n DESC) AS bigint)"},
        having="count(*) > 10",
        aggs={"n": "count(*)"},
        group_by=["region.r_name", "nation.n_name"],
        where="orders.o_orderstatus = 'F'",
        joins=[CUSTOMER_OF_ORDER, NATION_OF_CUSTOMER, REGION_OF_NATION],
    )


@query(
    "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey"
    " WHERE orders.o_totalprice > 400000"
)
def block_select_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        select=["orders.o_orderkey", "customer.c_name"],
        joins=[CUSTOMER_OF_ORDER],
        where="orders.o_totalprice > 400000",
    )


@query(
    f"SELECT o_orderdate, {EXACT_SUM.format('o_totalprice')} AS total_sales FROM orders"
    " JOIN customer ON o_custkey = c_custkey GROUP BY o_orderdate ORDER BY total_sales DESC, o_orderdate LIMIT 10"
)
def flagship_sales_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        select=["orders.o_orderdate", "customer.c_name"],
        joins=[CUSTOMER_OF_ORDER],
        group_by="o_orderdate",
        aggs={"total_sales": EXACT_SUM.format("o_totalprice")},
        order_by=[F.desc("total_sales"), "o_orderdate"],
        limit=10,
    )


@query(
    "SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(o_orderkey) AS total_customers FROM orders"
    " JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus, o_orderpriority"
    " ORDER BY total_customers DESC"
)
def sample_count_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        select=["o_orderkey", "o_custkey"],
        joins=[CUSTOMER_OF_ORDER],
        group_by="c_mktsegment,o_orderstatus,o_orderpriority",
        aggs={"total_customers": "count(o_orderkey)"},
        order_by=[F.desc("total_customers")],
    )


@query(
    "SELECT c_mktsegment, o_orderstatus, o_orderpriority, avg(l_quantity) AS avg_qty FROM lineitem"
    " JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    " GROUP BY c_mktsegment, o_orderstatus, o_orderpriority ORDER BY avg_qty DESC"
)
def sample_avg_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        joins=[CUSTOMER_OF_ORDER, Join("lineitem", "lineitem.l_orderkey = orders.o_orderkey")],
        group_by="c_mktsegment,o_orderstatus,o_orderpriority",
        aggs={"avg_qty": "avg(l_quantity)"},
        order_by=[F.desc("avg_qty")],
    )


@query(
    "SELECT o_orderpriority, count(*) AS n, count(l_quantity) AS counted, min(l_quantity) AS lo, max(l_quantity) AS hi,"
    f" {EXACT_SUM.format('l_extendedprice')} AS total, round(avg(l_quantity), 4) AS mean FROM orders"
    " LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderpriority"
)
def agg_below_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are combined by order before the join; orders without a returned line count as one row."""
    return query_block(
        parquet_tables(spark, sf_dir),
        "orders",
        joins=[Join("lineitem", "lineitem.l_orderkey = orders.o_orderkey AND lineitem.l_returnflag = 'R'", "left")],
        group_by="o_orderpriority",
        aggs={
            "n": "count(*)",
            "counted": "count(l_quantity)",
            "lo": "min(l_quantity)",
            "hi": "max(l_quantity)",
            "total": EXACT_SUM.format("l_extendedprice"),
            "mean": "round(avg(l_quantity), 4)",
        },
        combine_early="lineitem",
    )


@query("SELECT p_partkey AS part_id, p_name, p_retailprice AS price FROM part WHERE p_retailprice > 905")
def sample_rename_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_block(
        parquet_tables(spark, sf_dir),
        "part",
        select=["p_partkey", "p_name", "p_retailprice"],
        renames={"p_partkey": "part_id", "no_such_total": "total", "p_retailprice": "price", "no_such_rate": "rate"},
        where="p_retailprice > 905",
    )
