"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors are quantised to whole numbers, ``x = floor(scale * c)``, and packed into the fewest bytes an entry
needs, so equal vectors have equal bytes and ``distinct`` on them, combined on the map side first, gives the
fit list. Passes over it give the sums, the scatter of the centred vectors (one triangle of a matrix a
partition, added up by Spark) and the check that whitened vectors have the identity as covariance. Only
matrices as wide as a vector reach the driver.

There the scatter, divided by the number of vectors, is factored with pivots: ``V = L L'`` up to the order of
rows, where ``L`` has as many columns as ``V`` has rank. Rotating columns of ``L`` until all are orthogonal
leaves a matrix whose squared column norms are the eigenvalues and whose normalised columns are the components;
``V`` itself is never diagonalised, so small eigenvalues keep their digits.

Rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out. Vectors of different lengths
have no covariance with each other: each length is whitened by itself, with its own fit list. Components of
eigenvalue zero do not exist: a single distinct vector, constant dimensions, and empty vectors give
none for them. Entries beyond the range of a long are set to its ends. Repeated rows and NULL ids are kept, an empty
table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import Steps

WIDTHS = (1, 2, 4, 8)
AT_ONCE = 1 << 22
"""Bytes of packed vectors that a task unpacks at a time, or one vector."""

RANK_TOLERANCE = 1e-12
"""A row of which less than this share of its own variance is left depends on the pivots before it."""


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: their number and sums, the components as columns, and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened coordinates of each row of ``x``."""
        return (x - self.mean) @ self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as its width in bytes an entry, the least that holds all its entries, and the entries."""
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1))] = w
    out: list[bytes] = [b""] * len(x)
    for w in WIDTHS:
        at = np.flatnonzero(width == w)
        entries, step = x[at].astype(f"<i{w}").tobytes(), w * x.shape[1]
        for i, place in enumerate(at.tolist()):
            out[place] = bytes([w]) + entries[i * step : (i + 1) * step]
    return out


def unpacked(keys: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of packed rows, the places of those with the same length and width, and their vectors as longs."""
    groups: dict[tuple[int, int], list[int]] = {}
    keys = list(keys)
    for i, key in enumerate(keys):
        groups.setdefault((len(key), key[0]), []).append(i)
    for (size, width), at in sorted(groups.items()):
        entries = b"".join([keys[i][1:] for i in at])
        yield np.array(at), np.frombuffer(entries, f"<i{width}").reshape(len(at), (size - 1) // width).astype(np.int64)


def _slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their vectors fit into memory as doubles."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, AT_ONCE // pc.max(pc.binary_length(batch.column(column))).as_py())
            yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def quantised(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """``(vec_id, _x)`` of the vectors that take part, in whole numbers."""
    entries = F.col(column).cast("array<double>")
    broken = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.filter(F.col(column).isNotNull()).filter(~broken)
    return usable.select("vec_id", F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("_x"))


def _pack(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            entries = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            keys: list[bytes] = [b""] * batch.num_rows
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                rows = entries[starts[at][:, None] + np.arange(length)]
                for place, key in zip(at.tolist(), packed(rows), strict=True):
                    keys[place] = key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["vec_id", "_key"])

    return rows.mapInArrow(run, "vec_id long, _key binary")


def _sums(fit: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """By length: the number of vectors of the fit list and their exact sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in _slices(batches, "_key"):
            for _, x in unpacked(batch.column(0).to_pylist()):
                if x.shape[1]:
                    have = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                    small = int(np.abs(x.astype(float)).max()) < 2**62 // len(x)
                    have[0] += len(x)
                    have[1] += x.sum(0).astype(object) if small else x.astype(object).sum(0)
        rows = [(d, n, i, int(s)) for d, (n, sums) in total.items() for i, s in enumerate(sums)]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "n", "i", "s"])

    parts = fit.mapInArrow(run, "d int, n long, i int, s decimal(38,0)")
    whole = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, dict] = {}
    for d, i, n, s in whole.collect():
        found.setdefault(d, {"n": n, "sums": [0] * d})["sums"][i] = int(s)
    return {d: (f["n"], tuple(f["sums"])) for d, f in found.items()}


def _products(fit: DataFrame, coordinates: dict[int, Callable[[np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
    """By length: the sum of outer products of each vector's coordinates with themselves.

    A partition gives one triangle a length; triangles are added up entry by entry, so the driver gets one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in _slices(batches, "_key"):
            for _, x in unpacked(batch.column(0).to_pylist()):
                if x.shape[1] in coordinates:
                    y = coordinates[x.shape[1]](x)
                    total[x.shape[1]] = total.get(x.shape[1], 0.0) + y.T @ y
        for d, product in total.items():
            i, j = np.tril_indices(len(product))
            columns = [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(product[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "j", "s"])

    whole = fit.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    d, i, j, s = (whole.column(c).to_numpy() for c in ("d", "i", "j", "s"))
    found = {}
    for length in np.unique(d).tolist():
        at = d == length
        size = int(i[at].max()) + 1
        product = np.zeros((size, size))
        product[i[at], j[at]] = product[j[at], i[at]] = s[at]
        found[length] = product
    return found


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``L L' = v`` for a symmetric matrix without negative eigenvalues.

    The largest remaining diagonal entry is the next pivot. Rows keep their order, so ``L`` is triangular in the
    order of the pivots. It has one column for each pivot, which is the rank of ``v``.
    """
    rest, least, pivots = np.diag(v).copy(), RANK_TOLERANCE * np.diag(v), []
    factor = np.zeros(v.shape)
    while (rest > least).any():
        p, done = int(np.where(rest > least, rest, 0.0).argmax()), len(pivots)
        column = (v[:, p] - factor[:, :done] @ factor[p, :done]) / np.sqrt(rest[p])
        column[pivots] = 0.0
        column[p] = np.sqrt(rest[p])
        factor[:, done] = column
        pivots.append(p)
        rest -= column * column
        rest[pivots] = -1.0
    return factor[:, : len(pivots)]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal, longest first.

    Each round rotates disjoint pairs at once, and the rounds of a sweep meet every pair (a round-robin
    tournament). A sweep without any rotation is the last one.
    """
    rows, r = factor.shape
    n, least = r + r % 2, 2.3e-16 * max(4.0, rows**0.5)  # what rounding leaves of an inner product of orthogonal columns
    a = np.column_stack([factor, np.zeros((rows, n - r))])
    order = np.arange(n)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(n - 1, 0)):
            p, q = order[: n // 2], order[n // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > least * np.sqrt(xx * yy)
            if on.any():
                turned = True
                slope = np.where(on, yy - xx, 1.0) / np.where(on, 2 * xy, 1.0)
                t = np.where(on, np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope)), 0.0)
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - t * c * y, t * c * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    norms = (a * a).sum(0)
    kept = np.argsort(-norms, kind="stable")[:r]
    return a[:, kept]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a covariance, falling, and unit eigenvectors as columns, the largest entry positive."""
    rotated = one_sided_jacobi(pivoted_cholesky(v))
    values = (rotated * rotated).sum(0)
    rotated, values = rotated[:, values > 0], values[values > 0]
    vectors = rotated / np.sqrt(values)
    if len(values):
        top = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors


def fit_models(fit: DataFrame) -> dict[int, Model]:
    """The model of each length from the distinct packed vectors."""
    sums = _sums(fit)
    means = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}
    scatter = _products(fit, {d: (lambda x, m=m: x - m) for d, m in means.items()})
    models = {}
    for d, (n, total) in sums.items():
        values, vectors = spectrum(scatter[d] / n)
        trace = np.trace(scatter[d] / n)
        models[d] = Model(n, total, vectors, values, values / trace if trace > 0 else values)
    return models


def identity_errors(fit: DataFrame, models: dict[int, Model], k: int) -> dict[int, float]:
    """By length: the largest entry of the covariance of whitened vectors of the fit list minus the identity."""
    # centred once more: what rounding leaves of the mean of whitened vectors
    def ones(model: Model) -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: np.column_stack([np.ones(len(x)), model.whitened(x, k)])

    some = {d: m for d, m in models.items() if len(m.eigenvalues)}
    if not some:
        return {}
    means = {d: p[0, 1:] / some[d].n for d, p in _products(fit, {d: ones(m) for d, m in some.items()}).items()}
    centred = {d: (lambda x, m=m, mean=means[d]: m.whitened(x, k) - mean) for d, m in some.items()}
    return {d: float(np.abs(p / some[d].n - np.eye(len(p))).max()) for d, p in _products(fit, centred).items()}


def deviations(x: np.ndarray, model: Model) -> list[int]:
    """The exact sum over dimensions of ``(n * x - sum)`` squared, of each row."""
    n, sums = model.n, model.sums
    bound = int(np.abs(x.astype(float)).max(initial=0)) + 1
    if bound * bound * x.shape[1] < 2**62 and bound * sum(map(abs, sums)) < 2**62:
        squares, crossed = (x * x).sum(1).tolist(), (x @ np.array(sums, np.int64)).tolist()
        total = sum(s * s for s in sums)
        return [n * n * a - 2 * n * b + total for a, b in zip(squares, crossed, strict=True)]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def whiten(vectors: DataFrame, k: int, column: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: up to ``k`` rows a vector.

    ``n`` is the size of the fit list of the vector's length, ``deviation`` the exact sum over dimensions of
    ``(n * x - S)`` squared as decimal text (it outgrows a long on large tables), ``explained`` the share of the
    component in the trace, ``identity_error`` the largest over all lengths. Rows without a usable vector give none.
    """
    steps = Steps(vectors.sparkSession, "whitening")
    rows = steps.keep(_pack(quantised(vectors, column, scale)))
    fit = steps.keep(rows.select("_key").distinct())
    models = fit_models(fit)
    error = max(identity_errors(fit, models, k).values(), default=0.0)
    steps.drop(fit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_key"):
            for at, x in unpacked(batch.column(1).to_pylist()):
                model = models.get(x.shape[1])
                found = 0 if model is None else min(k, len(model.eigenvalues))
                if found:
                    size = len(at) * found
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(at, found))),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(size, model.n, np.int64)),
                        pa.array([str(v) for v in deviations(x, model) for _ in range(found)], pa.string()),
                        pa.array(model.whitened(x, k).ravel()),
                        pa.array(np.tile(model.explained[:found], len(at))),
                        pa.array(np.full(size, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, kinds)
