"""Reliable checkpoints in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one inside the warehouse, which all share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written once to shared storage, so later uses agree and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, for loops whose last table is the result.

    ``instead_of`` is a table written before, which is removed once this one stands.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        for folder in {f.rpartition("/")[0] for f in instead_of.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path)
