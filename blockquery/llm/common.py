"""What the operators of this package share: steps kept in shared storage, text bytes, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.sources.checkpoints import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Intermediate tables of one operator, written to shared storage.

    A written step cuts the lineage: a lost executor costs the running step only. Shuffle files of a step
    are removed as soon as its table is written, and ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of kept tables."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
            if f"/{self.folder.rpartition('/')[2]}/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def smallest_hashes(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` rows of smallest hash of the columns ``by``: a bounded sample that does not depend on the order of rows.

    The table is counted first, and rows that cannot be among them, by a wide margin, are filtered out where
    they are read, so the sort that takes the ``n`` gets a few times ``n`` rows from all tasks together.
    """
    place = F.xxhash64(*by).bitwiseAND((1 << 53) - 1)
    total = df.count()
    if total > 4 * n:
        df = df.filter(place < int((1 << 53) * (2 * n + 1000) / total))
    return df.orderBy(place, *by).limit(n)


def without_cycle_search[**P, R](function: Callable[P, R]) -> Callable[P, R]:
    """``function`` without Python's search for cyclic garbage, which walks over all kept words again each time many objects are made.

    Only for functions that make no cycles; all else is freed as ever.
    """

    @wraps(function)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        searched = gc.isenabled()
        gc.disable()
        try:
            return function(*args, **kwargs)
        finally:
            if searched:
                gc.enable()

    return run


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a column of texts; NULL counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def lists_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column of integers without NULLs, without copies."""
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over the links ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``: the smallest node of its component.

    Alternating stars: neighbours above a node move to the smallest neighbour, then those below it do.
    Each round is two aggregations and joins on the links, which only become fewer; a node with many links
    is one row of the aggregation, and its join side is split by adaptive execution. The number of rounds
    grows with the logarithm of the number of nodes.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = edges.join(least, "a")
        if larger:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.filter("a <> m").select("a", F.col("m").alias("b")))

    edges = steps.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = mark, edges
        edges = steps.keep(star(star(edges, True).distinct(), False).distinct())
        steps.drop(before)


def batches_of(batches: Iterable[pa.RecordBatch], size: int, column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``size`` bytes of a text column, and a row at least."""
    for batch in batches:
        lengths = np.cumsum([len(t) for t in texts_of(batch.column(column))])
        start = 0
        while start < batch.num_rows:
            before = lengths[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(lengths, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
