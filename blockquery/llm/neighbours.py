"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

The trees are built on a bounded sample: a node cuts the sample by the hyperplane between two of its points
drawn at random. Every row is then indexed under its leaf in each tree. A query keeps one queue over all
trees, ordered by how far the query lies on the wrong side of the cuts so far, and takes leaves from it until
a share of all leaves, ``OPENED``, is open. Their rows are compared exactly, in double precision, in blocks.

Rows of a leaf and queries of a leaf are joined as blocks of bounded size: a crowded leaf, such as one
vector that fills a third of the table, becomes many blocks. Each pair of blocks gives the nearest rows of
its queries only. The forest, which is all that is sent to every task, is bounded by the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockquery.llm.common import Steps, smallest_hashes

SAMPLE = 20_000
"""Vectors of smallest hash that the trees are built on, at most."""

TREES, LEAF = 8, 100
"""Trees, and sample vectors of a leaf at most."""

OPENED, LEAST_OPENED = 0.12, 64
"""Share of all leaves that a query opens, and the least number of leaves."""

BLOCK, QUERY_BLOCK = 2048, 256
"""Rows and queries of a block, on average at most."""


@dataclass(frozen=True)
class Tree:
    """Cuts by node: ``normal . x > cut`` goes to ``children[node, 1]``; a child below zero is the leaf ``-1 - child``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int


def build(sample: np.ndarray, seed: int) -> Tree:
    """One tree over unit vectors; points that no cut separates stay together in one leaf."""
    rng = np.random.default_rng(seed)
    normals, cuts, children = [], [], []
    leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        made = None
        for _ in range(5 if len(rows) > LEAF else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if not normal.any():
                continue
            at = sample[rows] @ normal
            cut = (a + b) @ normal / 2
            right = at > cut
            if min(right.sum(), (~right).sum()) * 20 >= len(rows):
                made = len(cuts)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[~right], made, 0), (rows[right], made, 1)]
                break
        if parent >= 0:
            children[parent][side] = leaf() if made is None else made
    shape = (len(cuts), sample.shape[1])
    return Tree(np.array(normals).reshape(shape), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), max(leaves, 1))


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector."""
    node = np.zeros(len(vectors), np.int64)
    if not len(tree.cuts):
        return node
    going = np.arange(len(vectors))
    while len(going):
        at = node[going]
        right = np.einsum("ij,ij->i", vectors[going], tree.normals[at]) > tree.cuts[at]
        node[going] = tree.children[at, right.astype(np.int64)]
        going = going[node[going] >= 0]
    return -1 - node


def open_leaves(forest: list[Tree], query: np.ndarray) -> list[tuple[int, int]]:
    """``(tree, leaf)`` of the leaves a query opens, nearest first over all trees."""
    most = max(LEAST_OPENED, round(OPENED * sum(t.leaves for t in forest)))
    margins = [t.normals @ query - t.cuts if len(t.cuts) else np.empty(0) for t in forest]
    queue = [(0.0, i, 0 if len(t.cuts) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    found: list[tuple[int, int]] = []
    while queue and len(found) < most:
        miss, tree, node = heapq.heappop(queue)
        while node >= 0:
            margin = float(margins[tree][node])
            right = int(margin > 0)
            other = int(forest[tree].children[node, 1 - right])
            heapq.heappush(queue, (max(miss, abs(margin)), tree, other))
            node = int(forest[tree].children[node, right])
        found.append((tree, -1 - node))
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: vectors as doubles, those that are finite and not all zero, with an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(
        F.forall("v", lambda x: F.coalesce(x.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    """The ``k`` nearest rows of each query: chosen by one product of matrices, scored and tied exactly."""
    a, b = _unit(queries), _unit(rows)
    rough = a @ b.T
    rough[query_ids[:, None] == ids] = -np.inf
    kth = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(a), -2.0)
    q, r = np.nonzero(rough >= (np.maximum(kth, -2.0) - 1e-9)[:, None])
    norms_q, norms_r = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    score = (queries[q] * rows[r]).sum(axis=1) / (norms_q[q] * norms_r[r])
    bad = ~np.isfinite(score)  # lengths beyond the range of doubles
    score[bad] = (a[q[bad]] * b[r[bad]]).sum(axis=1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return query_ids[q[keep]], ids[r[keep]], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest cosines found for each row of ``queries``.

    Both tables have ``vec_id`` and ``embedding``. A row is no neighbour of the query of its id; ties go to the
    smaller id. Rows without an id, NULL or zero vectors, and vectors with NULL or non-finite parts take no part. A
    query meets the vectors of its own length, and each length has its own forest. Equal rows count once. Other columns
    are not read.
    """
    steps = Steps(vectors.sparkSession, "neighbours")
    rows, asked = usable(vectors), usable(queries)
    lengths = sorted(r.n for r in asked.select(F.size("v").alias("n")).distinct().collect())
    found = [_search(rows.filter(F.size("v") == n), asked.filter(F.size("v") == n), k, steps) for n in lengths or [0]]
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, asked: DataFrame, k: int, steps: Steps) -> DataFrame:
    """The search among vectors of one length."""
    sample = smallest_hashes(rows, ["vec_id"], SAMPLE).select("v").toArrow().column("v").combine_chunks()
    points = _unit(_matrix(sample)) if len(sample) else np.empty((0, 1))
    forest = [build(points, seed) for seed in range(TREES)] if len(points) else []

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            for i, tree in enumerate(forest):
                leaf = pa.array(leaf_of(tree, unit).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), i, np.int32)), leaf, *batch.columns], ["tree", "leaf", "vec_id", "v"])

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [open_leaves(forest, q) for q in _unit(_matrix(batch.column(1)))]
            of = pa.array(np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]))
            tree, leaf = (pa.array([x[j] for found in leaves for x in found], pa.int32()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([tree, leaf, *[c.take(of) for c in batch.columns]], ["tree", "leaf", "vec_id", "v"])

    kinds = "tree int, leaf int, vec_id long, v array<double>"

    def blocks(leaved: DataFrame, size: int, name: str) -> DataFrame:
        counts = leaved.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        salted = leaved.join(counts, ["tree", "leaf"]).withColumn("part", F.expr(f"pmod(xxhash64(vec_id), div(n - 1, {size}) + 1)"))
        lists = [F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_values")]
        return salted.groupBy("tree", "leaf", "part").agg(*lists).drop("part")

    indexed = blocks(steps.keep(rows.distinct().mapInArrow(index, kinds)), BLOCK, "row")
    asked = blocks(steps.keep(asked.distinct().mapInArrow(opened, kinds)), QUERY_BLOCK, "query")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values, query_ids, query_values = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                found = _nearest(ids, values.reshape(len(ids), -1), query_ids, query_values.reshape(len(query_ids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    pairs = asked.join(indexed, ["tree", "leaf"]).select("row_ids", "row_values", "query_ids", "query_values")
    found = pairs.mapInArrow(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
