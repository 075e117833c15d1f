"""Scripts in, SQL files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.sources.checkpoints import reliable


def read_scripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(script_id, content)`` of the files under the paths (folders or globs); the id is the path.

    A file of length 0 gives no row: see ``listed_files``.
    """
    texts = spark.read.text(paths, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("content"))


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(script_id)`` of all files under the paths, also of those of length 0, which text readers skip.

    Spark keeps such a list for any read of the files, on the driver: some hundred bytes a file. Only names
    pass through here, so this serves up to some millions of files; beyond that, take the expected names from a table.
    """
    files = spark.read.text(paths).inputFiles()
    named = spark.createDataFrame([(f,) for f in files], "script_id string")
    return named.select(F.regexp_replace("script_id", "^file:/+", "file:/").alias("script_id"))


def rejects(scripts: DataFrame, expected: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``(script_id, reason)`` of scripts that are empty, and of expected ids that were not found.

    With ``listed`` (the files that exist), an existing file without text counts as empty, not missing.
    """
    blank = scripts.filter(~F.col("content").rlike(r"\S")).select("script_id", F.lit("empty").alias("reason"))
    found = scripts.select("script_id")
    if listed is not None:
        textless = listed.select("script_id").join(found, "script_id", "left_anti")
        blank = blank.union(textless.select("script_id", F.lit("empty").alias("reason")))
        found = found.union(textless)
    missing = expected.select("script_id").join(found, "script_id", "left_anti")
    return blank.union(missing.select("script_id", F.lit("missing").alias("reason")))


def write_sql(texts: DataFrame, folder: str, files: int) -> None:
    """Write SQL texts below a header per script, in order of script and chain, as text files.

    The texts are computed once, into shared storage; headers, the sample of the range partitioner and the
    files read them from there.

    Lines are range-partitioned, so files are of similar size whatever one script holds; a script that
    crosses from one file to the next goes on at the top of that file.
    """
    header = F.concat(
        F.lit("-- blockquery: chains of "),
        F.col("script_id").cast("string"),
        F.lit(" as SQL, "),
        F.current_timestamp().cast("string"),
        F.lit("\n"),
    )
    written = reliable(texts.filter("sql_text IS NOT NULL").select("script_id", "chain_no", "sql_text"))
    heads = written.groupBy("script_id").agg(F.lit(-1).alias("chain_no")).withColumn("value", header)
    bodies = written.select("script_id", "chain_no", F.concat("sql_text", F.lit(";\n")).alias("value"))
    lines = heads.select("script_id", "chain_no", "value").union(bodies)
    placed = lines.repartitionByRange(files, "script_id", "chain_no").sortWithinPartitions("script_id", "chain_no")
    placed.select("value").write.text(folder)
