import pytest
from pyspark.sql import functions as F

from blockquery.functions.names import base_of, column, join_type, last_part, quote, sort_column, split_names
from tests import frames


def test_quote():
    assert quote("a") == "`a`"
    assert quote("t.a b") == "`t`.`a b`"
    assert quote("t.*") == "`t`.*"
    assert quote("`a.b`") == "`a.b`"


def test_last_part():
    assert [last_part(n) for n in ("a", "t.a", "t.`a.b`", "`a.b`", "t.a b")] == ["a", "a", "a.b", "a.b", "a b"]


def test_split_names():
    assert split_names("a,b , c") == ["a", "b", "c"]
    assert split_names(["a", "b, c d"]) == ["a", "b", "c d"]
    assert split_names(["`x,y`", "z"]) == ["`x,y`", "z"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("inner", "inner"),
        ("INNER JOIN", "inner"),
        ("Left Outer", "left"),
        ("LEFT_OUTER", "left"),
        ("right", "right"),
        ("full outer join", "full"),
        ("outer", "full"),
        ("leftsemi", "left_semi"),
        ("LEFT ANTI", "left_anti"),
        ("anti", "left_anti"),
        ("cross join", "cross"),
    ],
)
def test_join_type(text, expected):
    assert join_type(text) == expected


def test_unknown_join_type():
    with pytest.raises(ValueError):
        join_type("sideways")


def test_base_of():
    assert base_of(["id", "orders.id", "customers.name"]) == "orders"
    with pytest.raises(ValueError):
        base_of(["id"])


def test_columns_with_blanks_and_dots(spark):
    df = frames.spaced(spark).alias("t")
    assert frames.rows_of(df.select(column("t.ship via port"), column("`a.b`"))) == [("down", 2), ("up", 1)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("age DESC", [40, 31, 31, 30, 12, None]),
        ("age", [None, 12, 30, 31, 31, 40]),
        ("age asc nulls last", [12, 30, 31, 31, 40, None]),
        ("desc(age)", [40, 31, 31, 30, 12, None]),
        ('asc("age")', [None, 12, 30, 31, 31, 40]),
        ("-age NULLS LAST", [40, 31, 31, 30, 12, None]),
    ],
)
def test_sort_text(spark, text, expected):
    assert [r.age for r in frames.people(spark).orderBy(sort_column(text)).collect()] == expected


def test_sort_column_passes_columns_through(spark):
    assert frames.people(spark).orderBy(sort_column(F.desc("age"))).first().age == 40
