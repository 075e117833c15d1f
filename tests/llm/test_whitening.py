"""Whitening against eigenvectors of the plain covariance, on every odd case."""

from collections import defaultdict

import numpy as np
import pytest

from blockquery.llm import whitening

KINDS = "vec_id long, embedding array<float>, label int, _key string, n long, component int, `a.b` int"


def table(spark, rows, kinds=KINDS):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], kinds)


def plain(rows, k=4):
    """``{(place of the row, component): (n, deviation, whitened, explained)}``, by ``numpy.linalg.eigh``."""
    by_length = defaultdict(list)
    for place, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            by_length[len(v)].append((place, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v)))
    out = {}
    for length, found in by_length.items():
        fit = sorted({x for _, x in found})
        if not length:
            continue
        n, sums = len(fit), [sum(x[i] for x in fit) for i in range(length)]
        mean = np.array([s / n for s in sums])
        centred = np.array(fit, float) - mean
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-values)
        for place, x in found:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for c, j in enumerate(order[:k]):
                if values[j] > 1e-9 * max(values.max(), 1e-300):
                    projected = (np.array(x) - mean) @ vectors[:, j] / np.sqrt(values[j])
                    out[place, c + 1] = (n, deviation, projected, values[j] / values.sum())
    return out


def check(spark, rows, kinds=KINDS):
    # ids may repeat or be NULL, so rows are told apart by all their values
    expected = plain(rows)
    found = whitening.whiten(table(spark, rows, kinds), k=4).collect()
    assert len(found) == len(expected)
    ours, theirs = defaultdict(list), defaultdict(list)
    for r in found:
        ours[r.vec_id, r.component].append((r.n, int(r.deviation), r.whitened, r.explained))
        assert r.identity_error <= 1e-9
    for (place, c), values in expected.items():
        theirs[rows[place][0], c].append(values)
    assert ours.keys() == theirs.keys()
    signs = defaultdict(set)
    for key, values in ours.items():
        a, b = sorted(values, key=lambda v: v[:2]), sorted(theirs[key], key=lambda v: v[:2])
        for (n, deviation, w, e), (n2, deviation2, w2, e2) in zip(a, b, strict=True):
            assert (n, deviation) == (n2, deviation2) and abs(e - e2) < 1e-9
            assert abs(abs(w) - abs(w2)) < 1e-7
            if abs(w2) > 1e-6:
                signs[n, key[1]].add(w * w2 > 0)
    assert all(len(s) == 1 for s in signs.values())


def vectors(n, length, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, length)) * np.linspace(1, 3, length) * scale).astype(np.float32).tolist()


def test_whitening(spark):
    rows = list(enumerate(vectors(60, 8, 1)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, vectors(1, 8, 9)[0])]  # repeats, ties, NULL ids
    rows += [(102, None), (103, [None] * 8), (104, [float("nan")] + [0.0] * 7), (105, [float("inf")] + [0.0] * 7), (106, [0.0] * 7 + [None]), (107, [])]
    rows += [(200 + i, v) for i, v in enumerate(vectors(9, 5, 2))]  # another length
    rows += [(300, [0.5, 0.25, 1.0])]  # a length with one vector: no covariance
    check(spark, rows)


def test_wide_scales_and_dependent_dimensions(spark):
    base = np.array(vectors(50, 4, 3))
    wide = np.column_stack([base[:, 0] * 3000, base[:, 1], base[:, 1], np.zeros(50), base[:, 2] + base[:, 3], base[:, 3]])
    check(spark, list(enumerate(wide.astype(np.float32).tolist())))


def test_huge_entries_stay_exact(spark):
    places = np.arange(-4, 5)
    rows = [(i, [float(v) * 1e9, float(v * v), 1.0]) for i, v in enumerate(places.tolist())]
    found = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows), k=4).collect()}
    assert len(found) == 18  # the dimension of ones has no component
    x = np.array([[256 * int(v) * 10**9, 256 * int(v * v), 256] for v in places], dtype=object)
    for i, row in enumerate(x):
        assert int(found[i, 1].deviation) == sum((9 * a - s) ** 2 for a, s in zip(row, x.sum(0)))
    # both dimensions are uncorrelated, so each component is one of them, the second 1e18 times smaller
    for c, column in ((1, places), (2, places**2)):
        expected = (column - column.mean()) / column.std()
        ours = np.array([found[i, c].whitened for i in range(9)])
        assert min(np.abs(ours - expected).max(), np.abs(ours + expected).max()) < 1e-9


def test_entries_beyond_a_long_are_set_to_its_ends(spark):
    kinds = KINDS.replace("<float>", "<double>")
    found = whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 3.0])], kinds), k=4).collect()
    top, low = (1 << 63) - 1, -(1 << 63)
    deviation = (2 * top - (top + low)) ** 2 + (2 * 256 - 1024) ** 2
    assert {(r.vec_id, r.n, int(r.deviation)) for r in found} == {(1, 2, deviation), (2, 2, (2 * low - (top + low)) ** 2 + (2 * 768 - 1024) ** 2)}


def test_empty_tables(spark):
    assert whitening.whiten(table(spark, []), k=4).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])]), k=4).collect() == []


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 1), (7, 7), (20, 12), (33, 33), (5, 0)])
def test_spectrum_of_matrices(size, rank):
    rng = np.random.default_rng(size)
    root = rng.normal(size=(size, rank)) * np.logspace(0, -3, rank) if rank else np.zeros((size, 1))
    v = root @ root.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, atol=1e-12)
    values, found = whitening.spectrum(v)
    expected = np.sort(np.linalg.eigvalsh(v))[::-1][:rank]
    assert np.allclose(values, expected, rtol=1e-9, atol=1e-14)
    assert np.allclose(found.T @ found, np.eye(rank), atol=1e-12) and np.allclose((found * values) @ found.T, v, atol=1e-12)
    # triangular in the order of the pivots
    zeros = [np.flatnonzero(factor[:, j] == 0) for j in range(rank)]
    assert all(len(z) >= j for j, z in enumerate(zeros))


def test_packed_rows_come_back():
    x = np.array([[0, 127], [-128, 5], [128, 0], [-40000, 7], [1 << 40, -1], [(1 << 63) - 1, -(1 << 63)]], dtype=np.int64)
    keys = whitening.packed(x)
    assert [k[0] for k in keys] == [1, 1, 2, 4, 8, 8]
    back = np.zeros_like(x)
    for at, rows in whitening.unpacked(keys):
        back[at] = rows
    assert (back == x).all()
