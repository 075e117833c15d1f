"""Base tables of chains through variables."""

import pytest

from blockquery.scripts.variables import base_tables

SCRIPT = """val a = spark.read.table("t").join("u", "t.k = u.k")
val b = a.filter("x > 1")
val c = b.join("w", "b.k = w.k").select("k")
val a = spark.read.table("other")
val d = a.select("x")
val e = c.join("t", "c.k = t.k")
val f = df.select("orders.id")
val g = f.limit(3)
val n = 42
val h = n.select("y")
val n = n.filter("z")
val i = later.count()
val later = spark.read.table("z")
val j = lost.filter("q = 1")"""
EXPECTED = {
    (0, "a"): {"t", "u"},
    (1, "b"): {"t", "u"},
    (2, "c"): {"t", "u", "w"},
    (3, "a"): {"other"},
    (4, "d"): {"other"},
    (5, "e"): {"t", "u", "w"},
    (6, "f"): {"orders"},
    (7, "g"): {"orders"},
    (9, "h"): {"n"},
    (10, "n"): {"n"},
    (11, "i"): {"later"},
    (12, "later"): {"z"},
    (13, "j"): {"lost"},
}


def found(spark, *contents, **options):
    scripts = spark.createDataFrame(list(enumerate(contents)), "script_id int, content string")
    out = {}
    for r in base_tables(scripts, **options).collect():
        out.setdefault((r.script_id, r.chain_no, r.variable), []).append(r.tbl)
    assert all(len(set(tables)) == len(tables) for tables in out.values())
    return {key: set(tables) for key, tables in out.items()}


@pytest.mark.parametrize("hot", [None, 1])
def test_base_tables(spark, hot):
    expected = {(0, *key): tables for key, tables in EXPECTED.items()}
    # names of one script are not those of another
    assert found(spark, SCRIPT, 'val k = a.select("x")', hot_rows=hot) == expected | {(1, 0, "k"): {"a"}}


def test_long_lines_of_variables(spark):
    lines = ['val v0 = spark.read.table("start")'] + [f'val v{i} = v{i - 1}.join("j{i % 3}", "k")' if i % 7 == 0 else f'val v{i} = v{i - 1}.filter("x > {i}")' for i in range(1, 40)]
    out = found(spark, "\n".join(lines))
    assert out[0, 39, "v39"] >= {"start"} and len(out) == 40 and out[0, 6, "v6"] == {"start"}


def test_nothing_to_find(spark):
    assert found(spark, "val n = 3", "") == {}
