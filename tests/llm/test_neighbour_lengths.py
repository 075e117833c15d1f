"""Vectors of several lengths: each query meets those of its own length, however rare."""

from collections import defaultdict

import numpy as np

from blockquery.llm import neighbours


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(11)
    lengths = {8: 100, 4: 99, 2: 3, 5: 1}
    vectors = [(i, rng.normal(size=n).tolist()) for i, n in enumerate(n for n, rows in lengths.items() for _ in range(rows))]
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.search(data, data.filter("vec_id % 50 = 0 OR vec_id >= 199"), 5).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    queries = [i for i, _ in vectors if i % 50 == 0 or i >= 199]
    assert {len(vectors[q][1]) for q in queries} == set(lengths)
    hits = total = 0
    for q in queries:
        own = np.array(vectors[q][1])
        cosine = {i: own @ np.array(v) / np.linalg.norm(own) / np.linalg.norm(v) for i, v in vectors if i != q and len(v) == len(own)}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        got = sorted(found[q])
        assert len(got) == len(best) and all(abs(s - cosine[i]) < 1e-12 for _, i, s in got)
        hits, total = hits + len(set(best) & {i for _, i, _ in got}), total + len(best)
    assert hits >= 0.9 * total
