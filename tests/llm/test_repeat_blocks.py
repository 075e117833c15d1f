"""Places of shared anchors travel in blocks, and ranges become runs, as plain versions say."""

import random

import numpy as np
import pyarrow as pa

from blockquery.llm import repeats


def blocks_of(table):
    n = len(table)
    columns = [np.array([r[i] for r in table], np.int64) for i in range(6)]
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([repeats._pack(columns)] if n else [], pa.binary())], ["bucket", "data"])


def test_a_task_sends_a_row_to_each_part_and_not_to_each_text():
    rng = random.Random(4)
    # hash, document, key, position, windows, flag: 300 texts share anchors, 50 have some of their own
    table = [(rng.randrange(40), k, k * 7 - 900, p, 256 * 3 + 5, repeats.ONE) for k in range(300) for p in range(4)]
    table += [(1000 + k, 500 + k, 5000 + k, 1, 5, repeats.ONE) for k in range(50)]
    labels = [11, 22, 33]
    rows = [b for half in (table[::2], table[1::2]) for b in repeats._shared(labels)([blocks_of(half)])]
    assert len(rows) <= 2 * len(labels)
    found = {}
    for label in labels:
        mine = [b for b in rows if b.column(0)[0].as_py() == label]
        for batch in repeats._gathered(mine):
            for key, pos, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert key not in found  # all of a text in one row
                found[key] = sorted(np.frombuffer(pos, np.uint32).tolist())
                assert set(np.frombuffer(span, np.uint16).tolist()) == {256 * 3 + 5}
    assert found == {k * 7 - 900: [0, 1, 2, 3] for k in range(300)}


def test_runs_of_ranges():
    rng = random.Random(5)
    rows = [[(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))] for _ in range(200)] + [None, []]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    column = pa.array([None if r is None else [{"start": a, "end": b} for a, b in r] for r in rows], kind)
    of, start, end = repeats.merged(column.slice(3), len(rows) - 3)
    for i, ranges in enumerate(rows[3:]):
        covered = {x for a, b in ranges or () for x in range(a, b)}
        runs = [(a, b) for o, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True) if o == i]
        assert {x for a, b in runs for x in range(a, b)} == covered
        assert runs == sorted(runs) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:], strict=False))
