"""Small inline frames with NULLs, duplicates, unmatched keys and awkward names."""


def people(spark):
    rows = [("ann", 30), ("bob", 31), (None, 40), ("cy", None), ("bob", 31), ("d  e", 12)]
    return spark.createDataFrame(rows, "name string, age int")


def emp(spark):
    rows = [("ann", 1), ("bob", 2), ("cy", 2), ("dan", None), ("eve", 9), ("ann", 1), ("eve", 9)]
    return spark.createDataFrame(rows, "name string, department_id long")


def dept(spark):
    rows = [(1, "sales"), (2, "ops"), (2, "ops b"), (3, "empty"), (None, "nowhere")]
    return spark.createDataFrame(rows, "id long, name string")


def spaced(spark):
    return spark.createDataFrame([("up", 1), ("down", 2)], "`ship via port` string, `a.b` int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def of_known_size(spark, df):
    """The same rows as values of the query itself, whose size Spark knows."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in df.collect())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(df.columns)})")
