"""Registered queries of the script layer, over scripts that are derived from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.plans.registry import query
from blockquery.scripts import facts, rollups
from blockquery.scripts.facts import JOIN_KEYWORDS
from blockquery.scripts.patterns import (
    GROUPED_CALLS,
    KNOWN_CALLS,
    LOOSE_GROUPING,
    NAME,
    ORDER_CHANGES_MEANING,
    QUOTED,
    Patterns,
)
from blockquery.scripts.nested_sql import nested_sql_text
from blockquery.scripts.sql_text import AGGREGATE, PLAIN_NAME, SORT_KEY, sql_text
from blockquery.scripts.variables import base_tables
from blockquery.sources.script_files import rejects
from blockquery.sources.tables import parquet_tables

# One script per customer, the same text in both engines: comments that hold code, comment signs inside
# strings, chains over several lines, packed keys, two aggregates, names with blanks, a rename of an absent
# column, repeated predicates, filters on a derived column, calls that SQL cannot say, orders of calls that SQL would change, a stray quote, and
# assignments without a chain.
SCRIPT = """concat(
'// header val z = spark.read.table("no")', chr(10),
'val a = spark.read.table("t', cast(c_nationkey AS varchar(20)), '").select("x", "y").filter("x >= ',
cast(c_custkey AS varchar(20)), '").where("y <> ', chr(39), 'http://', c_mktsegment, chr(39), '") // http', chr(10),
'/* block', chr(10), ' val y = text.of(1) */', chr(10),
CASE WHEN c_custkey % 3 = 0 THEN concat('val u = spark.read.table("raw").union("other")', chr(10)) ELSE '' END,
'val b = spark.read.table("sales").select("sales.date")', chr(10),
'  .join("customers", "sales.customer_id = customers.id"',
CASE WHEN c_custkey % 2 = 0 THEN ', "left_outer"' ELSE '' END, ').', chr(10),
'  join("regions", "customers.region = regions.id", "inner")', chr(10),
'  .groupBy("date, kind").agg(sum("amount").as("total"), count("*").as("n"), max("net price"))', chr(10),
'  .filter("n > 1 OR total > 5").orderBy(desc("total"), "n ASC").limit(', cast(c_nationkey + 1 AS varchar(20)), ')', chr(10),
'val c = df.select("', lower(c_mktsegment), '.id", "ship via port").distinct()', chr(10),
'  .withColumnRenamed("ship via port", "label").withColumnRenamed("absent", "other").orderBy("id DESC")', chr(10),
'val d = c.where("k = 1 OR k = 2").filter("v < ', cast(c_acctbal AS varchar(20)), '").filter("k = 1 OR k = 2")', chr(10),
'  .withColumn("twice", expr("(v + (k * 2)) * 2")).select("k", "v")', chr(10),
'val e = a.groupBy("x", "y").count()', chr(10),
CASE WHEN c_custkey % 5 = 0 THEN concat('val f = spark.read.table("t").select("a"", "b")', chr(10)) ELSE '' END,
CASE WHEN c_acctbal < 1000 THEN concat('val g = a.filter(col("x") > 1).limit(5).filter("y = 2")', chr(10)) ELSE '' END,
'val h = a.withColumn("w', cast(c_nationkey AS varchar(20)), '", expr("x * 2")).filter("x > 1").where("w7 > 3")', chr(10),
CASE c_custkey % 8
 WHEN 0 THEN 'val p = t.select("a", "b").distinct().select("a")'
 WHEN 1 THEN 'val p = t.select("a").distinct().withColumn("a", expr("a % 2"))'
 WHEN 2 THEN 'val p = t.select("a", "b").withColumn("a", expr("a + 1")).withColumn("c", expr("a * 2"))'
 WHEN 3 THEN 'val p = t.select("a").withColumn("a", expr("a + 1")).withColumn("a", expr("a * 2"))'
 WHEN 4 THEN 'val p = t.withColumn("a", expr("a + 1")).orderBy("b, c")'
 WHEN 5 THEN concat('val p = t.filter("a > 1").join("u", "t.a = u.a", "', CASE WHEN c_nationkey < 12 THEN 'full' ELSE 'right' END, '")')
 WHEN 6 THEN 'val p = t.orderBy("x").groupBy("k").count()'
 ELSE 'val p = t.select("k", "v").withColumn("twice", expr("v * 2")).distinct()' END, chr(10),
'val n = ', cast(c_nationkey AS varchar(20)), chr(10))"""

# A corpus with blank scripts, and customers without a script.
SPARSE_SCRIPT = "CASE WHEN c_nationkey = 7 THEN concat(' ', chr(10)) ELSE concat('val a = spark.read.table(\"', c_name, '\")') END"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per customer.

    A row of some 30 bytes becomes a text of more than 1 KB that costs as much work, so input splits, which
    are sized in bytes, would make tasks far too long. The narrow rows are spread first.
    """
    customer = parquet_tables(spark, sf_dir)("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    spread = customer.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return spread.select(F.col("c_custkey").alias("script_id"), F.expr(SCRIPT).alias("content"))


def corpus_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.calls(facts.chains(corpus(spark, sf_dir)))


# --- the same facts in SQL -----------------------------------------------------------------------

AUTOMATON = Patterns(possessive=False)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(values) -> str:
    return ", ".join(map(_text, values))


def _extract(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {_text(pattern)}, {group})"


def _extract_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_text(pattern)}, {group})"


def _like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_text(pattern)})"


def _quoted_if_needed(name: str) -> str:
    return f"CASE WHEN {_like(name, PLAIN_NAME)} THEN {name} ELSE '`' || replace({name}, '.', '`.`') || '`' END"


def _names_sql(step: str) -> str:
    packed = f"string_split(array_to_string({_extract_all(step, QUOTED, 1)}, ','), ',')"
    return f"list_filter(list_transform({packed}, lambda v: trim(v)), lambda v: v <> '')"


def _string_sql(step: str, position: int) -> str:
    return f"{_extract_all(step, QUOTED, 1)}[{position + 1}]"


_SPELLED = f"regexp_replace(lower(coalesce({_string_sql('step', 2)}, 'inner')), '[\\s_]+|outer|join', '', 'g')"
JOIN_KEYWORD_SQL = f"CASE {_SPELLED} {' '.join(f'WHEN {_text(k)} THEN {_text(v)}' for k, v in JOIN_KEYWORDS.items())} END"

SCRIPTS_SQL = f"WITH s AS (SELECT c_custkey AS script_id, {SCRIPT} AS content FROM customer)"
CLEAN_SQL = f"""{SCRIPTS_SQL},
cleaned AS (SELECT script_id, regexp_replace(content, {_text(AUTOMATON.comment)}, '\\1', 'g') AS content FROM s)"""
ASSIGNED_SQL = f"""{CLEAN_SQL},
found AS (SELECT script_id, {_extract_all("content", AUTOMATON.assignment)} AS texts FROM cleaned),
texts AS (SELECT script_id, unnest(texts) AS text, cast(generate_subscripts(texts, 1) - 1 AS integer) AS chain_no FROM found),
assigned AS (SELECT script_id, chain_no, {_extract("text", "^val\\s+(\\w+)")} AS variable,
 CASE WHEN NOT {_like("text", "=$")} THEN {_extract("text", f"=\\s*({NAME})")} END AS root,
 CASE WHEN NOT {_like("text", "=$")} THEN text END AS chain,
 CASE WHEN NOT {_like("text", "=$")} THEN NOT {_like("text", "[({\\[]$")} END AS whole FROM texts)"""
CALLS_SQL = f"""{ASSIGNED_SQL},
split AS (SELECT script_id, chain_no, {_extract_all("chain", AUTOMATON.call)} AS steps FROM assigned WHERE chain IS NOT NULL),
steps AS (SELECT script_id, chain_no, cast(generate_subscripts(steps, 1) - 1 AS integer) AS step_no, unnest(steps) AS step FROM split),
calls AS (SELECT script_id, chain_no, step_no, {_extract("step", f"^\\.\\s*({NAME})")} AS op, step,
 {_like("step", AUTOMATON.readable_call)} AS readable FROM steps)"""
ORDERS_SQL = f"""{CALLS_SQL},
ordered AS (SELECT script_id, chain_no, concat(' ', string_agg(op, ' ' ORDER BY step_no), ' ') AS ops, bool_and(readable) AS readable,
 min(CASE WHEN op = 'groupBy' THEN step_no END) AS grouped_at FROM calls GROUP BY script_id, chain_no),
made AS (SELECT script_id, chain_no, step_no, {_string_sql("step", 0)} AS name FROM calls WHERE op = 'withColumn'
 UNION ALL SELECT script_id, chain_no, step_no, {_string_sql("step", 1)} FROM calls WHERE op = 'withColumnRenamed'),
reads AS (SELECT script_id, chain_no, step_no, {_string_sql("step", 0)} AS condition FROM calls WHERE op IN ('filter', 'where')
 UNION ALL SELECT script_id, chain_no, step_no, {_string_sql("step", 1)} FROM calls WHERE op = 'join'
 UNION ALL SELECT script_id, chain_no, step_no, array_to_string({_extract_all("step", QUOTED, 1)}, ' ') FROM calls WHERE op = 'withColumn'),
clashes AS (SELECT DISTINCT r.script_id, r.chain_no, true AS clash FROM reads r JOIN made m
 ON r.script_id = m.script_id AND r.chain_no = m.chain_no AND m.step_no < r.step_no
 WHERE list_contains(regexp_split_to_array(r.condition, '\\W+'), m.name)
 UNION SELECT m.script_id, m.chain_no, true FROM calls m JOIN calls s
 ON s.script_id = m.script_id AND s.chain_no = m.chain_no AND m.step_no < s.step_no
 WHERE m.op = 'withColumn' AND s.op = 'select' AND NOT list_contains({_names_sql("s.step")}, {_string_sql("m.step", 0)})
 UNION SELECT m.script_id, m.chain_no, true FROM calls m WHERE m.op = 'withColumn'
 AND list_contains(regexp_split_to_array(array_to_string({_extract_all("m.step", QUOTED, 1)}[2:], ' '), '\\W+'), {_string_sql("m.step", 0)})
 AND NOT EXISTS (SELECT 1 FROM calls s WHERE s.script_id = m.script_id AND s.chain_no = m.chain_no AND s.op = 'select')),
outer_joins AS (SELECT DISTINCT j.script_id, j.chain_no, true AS late FROM (SELECT script_id, chain_no, step_no, step, {JOIN_KEYWORD_SQL} AS kind FROM calls WHERE op = 'join') j
 JOIN calls f ON f.script_id = j.script_id AND f.chain_no = j.chain_no AND f.step_no < j.step_no
 WHERE f.op IN ('filter', 'where') AND j.kind IN ('RIGHT OUTER', 'FULL OUTER')),
judged AS (SELECT ordered.*, {_like("ops", ORDER_CHANGES_MEANING)} OR
 {_like(f"regexp_replace(ops, {_text(GROUPED_CALLS)}, ' ', 'g')", LOOSE_GROUPING)} OR (grouped_at IS NULL AND clash IS NOT NULL) OR late IS NOT NULL AS bad_order
 FROM ordered LEFT JOIN clashes USING (script_id, chain_no) LEFT JOIN outer_joins USING (script_id, chain_no))"""
LINEAGE_SQL = f"""SELECT script_id, chain_no, step_no, CASE WHEN op = 'join' THEN 'join' ELSE 'from' END AS role,
 {_string_sql("step", 0)} AS tbl, CASE WHEN op = 'join' THEN {JOIN_KEYWORD_SQL} END AS join_type,
 CASE WHEN op = 'join' THEN {_string_sql("step", 1)} END AS cond FROM calls WHERE op IN ('table', 'join') AND readable"""

_AGGREGATE_CALL = f"""concat({_extract("text", AGGREGATE, 1)}, '(', {_quoted_if_needed(_extract("text", AGGREGATE, 2))}, ')')"""
_SORT_NAME = f"""trim({_extract(_string_sql("text", 0), "^(.*?)(?:\\s+(?i:asc|desc))?$")})"""
_SORT_DIRECTION = f"""upper(concat({_extract("text", "^(asc|desc)\\s*\\(")}, {_extract(_string_sql("text", 0), "\\s+((?i:asc|desc))$")}))"""
SQL_TEXT_SQL = f"""{ORDERS_SQL},
good AS (SELECT calls.*, coalesce(grouped_at, 1000000) AS grouped_at FROM calls JOIN judged USING (script_id, chain_no)
 JOIN assigned USING (script_id, chain_no) WHERE judged.readable AND NOT bad_order AND whole),
last_select AS (SELECT script_id, chain_no, arg_max(step, step_no) AS step FROM good WHERE op = 'select' GROUP BY ALL),
is_grouped AS (SELECT script_id, chain_no, bool_or(op = 'groupBy') AS is_grouped FROM good GROUP BY ALL),
item_lists AS (
 SELECT script_id, chain_no, 1 AS part, {_names_sql("step")} AS texts FROM last_select JOIN is_grouped USING (script_id, chain_no) WHERE NOT is_grouped
 UNION ALL SELECT script_id, chain_no, 1, ['*'] FROM is_grouped ANTI JOIN last_select USING (script_id, chain_no) WHERE NOT is_grouped
 UNION ALL SELECT script_id, chain_no, 1, {_names_sql("step")} FROM good WHERE op = 'groupBy'
 UNION ALL SELECT script_id, chain_no, 2, {_extract_all("step", AGGREGATE)} FROM good WHERE op = 'agg'
 UNION ALL SELECT script_id, chain_no, 2, ['count(*)'] FROM good WHERE op = 'count'
 UNION ALL SELECT script_id, chain_no, 3 + step_no, [step] FROM good WHERE op = 'withColumn'),
item_texts AS (SELECT script_id, chain_no, part, unnest(texts) AS text, generate_subscripts(texts, 1) AS place FROM item_lists),
items AS (SELECT script_id, chain_no, part, place,
 CASE WHEN part = 1 THEN {_quoted_if_needed("text")} WHEN text = 'count(*)' THEN text WHEN part = 2 THEN {_AGGREGATE_CALL}
  ELSE regexp_replace(trim({_extract("text", '"[^"]*"\\s*,([\\s\\S]*)\\)$')}), '^expr\\s*\\(\\s*"([^"]*)"\\s*\\)$', '\\1') END AS text,
 CASE WHEN part = 1 THEN {_extract("text", "([^.]*)$")} WHEN text = 'count(*)' THEN 'count'
  WHEN part = 2 THEN coalesce(nullif({_extract("text", AGGREGATE, 3)}, ''), {_AGGREGATE_CALL}) ELSE {_string_sql("text", 0)} END AS name FROM item_texts),
renames AS (SELECT script_id, chain_no, {_string_sql("step", 0)} AS name, {_string_sql("step", 1)} AS new_name FROM good WHERE op = 'withColumnRenamed'),
named AS (SELECT script_id, chain_no, part, place, text, coalesce(new_name, name) AS name,
 CASE WHEN part = 1 THEN name WHEN part = 2 AND text <> 'count(*)' THEN text END AS own_name FROM items LEFT JOIN renames USING (script_id, chain_no, name)),
select_lists AS (SELECT script_id, chain_no, string_agg(CASE WHEN name IS NOT DISTINCT FROM own_name THEN text
 ELSE concat(text, ' AS ', {_quoted_if_needed("name")}) END, ', ' ORDER BY part, place) AS items FROM named GROUP BY ALL),
filters AS (SELECT script_id, chain_no, step_no > grouped_at AS late, trim({_string_sql("step", 0)}) AS p, min(step_no) AS first
 FROM good WHERE op IN ('filter', 'where') GROUP BY ALL),
conditions AS (SELECT script_id, chain_no, late, CASE WHEN count(*) = 1 THEN min(p) ELSE string_agg(concat('(', p, ')'), ' AND ' ORDER BY first) END AS c
 FROM filters GROUP BY ALL),
joins AS (SELECT script_id, chain_no, string_agg(concat({JOIN_KEYWORD_SQL}, ' JOIN `', {_string_sql("step", 0)}, '` ON ', {_string_sql("step", 1)}), ' ' ORDER BY step_no) AS joins
 FROM good WHERE op = 'join' GROUP BY ALL),
key_lists AS (SELECT script_id, chain_no, array_to_string(list_transform({_names_sql("step")}, lambda v: {_quoted_if_needed("v")}), ', ') AS keys FROM good WHERE op = 'groupBy'),
sort_lists AS (SELECT script_id, chain_no, array_to_string(list_transform({_extract_all("step", SORT_KEY)}, lambda text:
 concat_ws(' ', {_quoted_if_needed(_SORT_NAME)}, nullif({_SORT_DIRECTION}, ''))), ', ') AS sort FROM good WHERE op = 'orderBy'),
simple AS (SELECT script_id, chain_no, max(CASE WHEN op = 'table' THEN {_string_sql("step", 0)} END) AS tbl,
 max(CASE WHEN op = 'select' THEN nullif({_extract(_string_sql("step", 0), "^([^.,]*)[.]")}, '') END) AS qualifier,
 min(CASE WHEN op = 'limit' THEN {_extract("step", "(\\d+)")} END) AS lim, bool_or(op = 'distinct') AS is_distinct FROM good GROUP BY ALL)
SELECT assigned.script_id, assigned.chain_no, CASE WHEN items IS NOT NULL THEN concat_ws(' ', CASE WHEN is_distinct THEN 'SELECT DISTINCT' ELSE 'SELECT' END,
 items, concat('FROM `', coalesce(tbl, qualifier, root), '`'), joins, 'WHERE ' || w.c, 'GROUP BY ' || keys, 'HAVING ' || h.c, 'ORDER BY ' || sort, 'LIMIT ' || lim) END AS sql_text
FROM assigned LEFT JOIN simple USING (script_id, chain_no) LEFT JOIN select_lists USING (script_id, chain_no) LEFT JOIN joins USING (script_id, chain_no)
 LEFT JOIN key_lists USING (script_id, chain_no) LEFT JOIN sort_lists USING (script_id, chain_no)
 LEFT JOIN conditions w ON w.script_id = assigned.script_id AND w.chain_no = assigned.chain_no AND NOT w.late
 LEFT JOIN conditions h ON h.script_id = assigned.script_id AND h.chain_no = assigned.chain_no AND h.late
WHERE chain IS NOT NULL"""


# --- the queries ---------------------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT c_custkey AS script_id, {SPARSE_SCRIPT} AS content FROM customer WHERE c_acctbal > 0)
SELECT script_id, 'empty' AS reason FROM s WHERE trim(content, ' ' || chr(10)) = ''
UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT script_id FROM s)"""
)
def scripts_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = parquet_tables(spark, sf_dir)("customer")
    found = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("script_id"), F.expr(SPARSE_SCRIPT).alias("content"))
    return rejects(found, customer.select(F.col("c_custkey").alias("script_id")))


@query(f"{CLEAN_SQL} SELECT script_id, content FROM cleaned")
def scripts_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.clean(corpus(spark, sf_dir))


@query(f"{ASSIGNED_SQL} SELECT * FROM assigned WHERE chain IS NOT NULL")
def script_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.chains(corpus(spark, sf_dir))


@query(f"{CALLS_SQL} SELECT * FROM calls")
def script_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_calls(spark, sf_dir)


@query(f"{CALLS_SQL} {LINEAGE_SQL}")
def script_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.lineage(corpus_calls(spark, sf_dir))


@query(
    f"""{CALLS_SQL.replace("WITH s", "WITH RECURSIVE s", 1)}, edges AS ({LINEAGE_SQL}),
linked AS (SELECT a.script_id, a.chain_no, a.variable, a.root, max(b.chain_no) AS def_no FROM assigned a LEFT JOIN assigned b
 ON b.script_id = a.script_id AND b.variable = a.root AND b.chain_no < a.chain_no WHERE a.chain IS NOT NULL GROUP BY ALL),
reading AS (SELECT DISTINCT script_id, chain_no, true AS reads FROM edges WHERE role = 'from'),
parents AS (SELECT l.*, CASE WHEN reads IS NULL AND p.chain IS NOT NULL THEN def_no END AS parent, reads IS NULL AND p.chain IS NULL AS alone FROM linked l
 LEFT JOIN reading USING (script_id, chain_no) LEFT JOIN assigned p ON p.script_id = l.script_id AND p.chain_no = l.def_no),
qualified AS (SELECT script_id, chain_no, arg_min(nullif({_extract(_string_sql("step", 0), "^([^.,]*)[.]")}, ''), step_no) AS qualifier
 FROM calls WHERE op = 'select' AND readable GROUP BY ALL),
own AS (SELECT script_id, chain_no, tbl FROM edges UNION
 SELECT script_id, chain_no, coalesce(qualifier, root) FROM parents LEFT JOIN qualified USING (script_id, chain_no) WHERE alone),
reach AS (SELECT script_id, chain_no, variable, chain_no AS place FROM parents
 UNION ALL SELECT r.script_id, r.chain_no, r.variable, p.parent FROM reach r JOIN parents p ON p.script_id = r.script_id AND p.chain_no = r.place WHERE p.parent IS NOT NULL)
SELECT DISTINCT r.script_id, r.chain_no, r.variable, o.tbl FROM reach r JOIN own o ON o.script_id = r.script_id AND o.chain_no = r.place"""
)
def script_base_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables that each chain rests on, also through the variables it starts from."""
    return base_tables(corpus(spark, sf_dir))


@query(
    f"{CALLS_SQL} SELECT script_id, chain_no, op, unnest({_names_sql('step')}) AS name FROM calls"
    " WHERE op IN ('select', 'groupBy') AND readable"
)
def script_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.columns(corpus_calls(spark, sf_dir))


@query(
    f"{CALLS_SQL} SELECT script_id, chain_no, {_string_sql('step', 0)} AS predicate FROM calls"
    " WHERE op IN ('filter', 'where') AND readable"
)
def script_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.predicates(corpus_calls(spark, sf_dir))


@query(SQL_TEXT_SQL)
def script_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_text(facts.chains(corpus(spark, sf_dir)))


@query(
    f"""{ORDERS_SQL}
SELECT script_id, chain_no, 'no chain' AS reason, cast(NULL AS varchar) AS op FROM assigned WHERE chain IS NULL
UNION ALL SELECT script_id, chain_no, 'order of calls', NULL FROM judged WHERE bad_order
UNION ALL SELECT script_id, chain_no, CASE WHEN op IN ({_words(KNOWN_CALLS)}) THEN 'unread arguments' ELSE 'unknown call' END, op
 FROM calls WHERE NOT readable"""
)
def script_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unsupported(corpus(spark, sf_dir))


@query(f"{CALLS_SQL} SELECT op, count(*) AS count FROM calls GROUP BY op")
def script_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.op_counts(corpus_calls(spark, sf_dir))


@query(f"{CALLS_SQL} SELECT tbl, count(*) AS count FROM ({LINEAGE_SQL}) e GROUP BY tbl")
def script_table_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.table_popularity(facts.lineage(corpus_calls(spark, sf_dir)))


@query(
    f"""{CALLS_SQL}, edges AS ({LINEAGE_SQL})
SELECT f.tbl AS base, j.tbl AS joined, count(*) AS count FROM edges f JOIN edges j USING (script_id, chain_no)
WHERE f.role = 'from' AND j.role = 'join' GROUP BY f.tbl, j.tbl"""
)
def script_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.join_pairs(facts.chains(corpus(spark, sf_dir)))


# What each chain of SCRIPT says, written out by hand: none of the library's patterns takes part.
NESTED = {
    "a": (1, """concat('SELECT x, y FROM `t', c_nationkey, '` WHERE (x >= ', c_custkey, ') AND (y <> ', chr(39), 'http://', c_mktsegment, chr(39), ')')"""),
    "b": (
        1,
        """concat('SELECT date, kind, sum(amount) AS total, count(*) AS n, max(`net price`) FROM `sales` ',
 CASE WHEN c_custkey % 2 = 0 THEN 'LEFT OUTER' ELSE 'INNER' END, ' JOIN `customers` ON sales.customer_id = customers.id',
 ' INNER JOIN `regions` ON customers.region = regions.id GROUP BY date, kind HAVING n > 1 OR total > 5 ORDER BY total DESC, n ASC LIMIT ', c_nationkey + 1)""",
    ),
    "c": (1, "concat('SELECT DISTINCT ', lower(c_mktsegment), '.id, `ship via port` AS label FROM `', lower(c_mktsegment), '` ORDER BY id DESC')"),
    "d": (
        2,
        "concat('SELECT k, v FROM (SELECT *, (v + (k * 2)) * 2 AS twice FROM `c` WHERE (k = 1 OR k = 2) AND (v < ', cast(c_acctbal AS varchar(20)), ')) AS `c`')",
    ),
    "e": (1, "'SELECT x, y, count(*) AS count FROM `a` GROUP BY x, y'"),
    "h": (
        "CASE WHEN c_nationkey = 7 THEN 2 ELSE 1 END",
        """CASE WHEN c_nationkey = 7 THEN 'SELECT * FROM (SELECT *, x * 2 AS w7 FROM `a` WHERE x > 1) AS `a` WHERE w7 > 3'
 ELSE concat('SELECT *, x * 2 AS w', c_nationkey, ' FROM `a` WHERE (x > 1) AND (w7 > 3)') END""",
    ),
    "p": (
        "CASE WHEN c_custkey % 8 IN (4, 7) THEN 1 ELSE 2 END",
        """CASE c_custkey % 8 WHEN 0 THEN 'SELECT a FROM (SELECT DISTINCT a, b FROM `t`) AS `t`'
 WHEN 1 THEN 'SELECT * EXCEPT (a), a % 2 AS a FROM (SELECT DISTINCT a FROM `t`) AS `t`'
 WHEN 2 THEN 'SELECT *, a * 2 AS c FROM (SELECT a + 1 AS a, b FROM `t`) AS `t`'
 WHEN 3 THEN 'SELECT * EXCEPT (a), a * 2 AS a FROM (SELECT a + 1 AS a FROM `t`) AS `t`'
 WHEN 4 THEN 'SELECT * EXCEPT (a), a + 1 AS a FROM `t` ORDER BY b, c'
 WHEN 5 THEN concat('SELECT * FROM (SELECT * FROM `t` WHERE a > 1) AS `t` ', CASE WHEN c_nationkey < 12 THEN 'FULL' ELSE 'RIGHT' END, ' OUTER JOIN `u` ON t.a = u.a')
 WHEN 6 THEN 'SELECT k, count(*) AS count FROM (SELECT * FROM `t` ORDER BY x) AS `t` GROUP BY k'
 ELSE 'SELECT DISTINCT k, v, v * 2 AS twice FROM `t`' END""",
    ),
}


@query(
    " UNION ALL ".join(
        f"SELECT c_custkey AS script_id, '{variable}' AS variable, CAST({blocks} AS INTEGER) AS blocks, {text} AS sql_text FROM customer"
        for variable, (blocks, text) in NESTED.items()
    )
)
def script_sql_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain that can be read has text, in as many blocks as the order of its calls needs."""
    found = nested_sql_text(facts.chains(corpus(spark, sf_dir)))
    return found.filter("sql_text IS NOT NULL").select("script_id", "variable", "blocks", "sql_text")
