"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt to cells by the population counts of their parts (one part: the count of
the whole fingerprint). Two fingerprints whose counts differ by more than the radius, summed over the
parts, differ in more bits than the radius, so such cells are never brought together. Cells are cut into
tiles of bounded size; each pair of tiles is compared whole, with exclusive-or and bit counts in numpy.

A pair of tiles gives a spanning forest of its links, so a group of thousands of near copies gives rows in
proportion to its members and not to its pairs; which documents are connected stays the same.

Memory: a task holds two tiles at a time. Copies share one fingerprint and cost one row of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import Steps, components, forest, lists_of, texts_of

U = np.uint64

TILE = 2048
"""Fingerprints of a tile, on average at most."""


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; fewer words than a shingle has are one, and no words none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(found))
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)
    return np.fromiter((hash64(joined[a:b], seed) for a, b in spans), np.uint64, len(found) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits of hashes, as a signed integer; 0 if there are none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long. NULL texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, words)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, radius: int, parts: int, steps: Steps) -> DataFrame:
    """``(a, b)``: links that connect the distinct fingerprints ``fp`` as all pairs within the radius would."""
    bits = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * bits).bitwiseAND((1 << bits) - 1 if parts > 1 else -1)) for i in range(parts)]
    base = bits + 1

    def cell(values: list) -> F.Column:
        out = F.lit(0)
        for v in values:
            out = out * base + v
        return out.cast("long")

    distinct = steps.keep(prints.select("fp").distinct().withColumn("cell", cell(counts)))
    sizes = distinct.groupBy("cell").agg(F.count("*").alias("n"))
    tiles = (
        distinct.join(sizes, "cell")
        .withColumn("tile", F.expr(f"pmod(xxhash64(fp), div(n - 1, {TILE}) + 1)"))
        .groupBy("cell", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = steps.keep(tiles)
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]
    steps_to = F.array(*[F.lit(sum(x * base ** (parts - 1 - i) for i, x in enumerate(d))) for d in near])
    # a step over the edge of a count's range reaches a cell of other counts: more comparisons, no other links
    here = tiles.select(F.col("cell").alias("at"), F.col("tile").alias("here"), F.col("fps").alias("a"))
    there = tiles.select(F.explode(steps_to).alias("step"), "cell", "tile", F.col("fps").alias("b"))
    there = there.select((F.col("cell") - F.col("step")).alias("at"), (F.col("step") == 0).alias("same"), F.col("tile").alias("there"), "b")
    pairs = here.join(there, "at").filter("NOT same OR here <= there")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_within(a, b, radius) for a, b in zip(lists_of(batch.column(0)), lists_of(batch.column(1)), strict=True)]
            left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    rows = max(1, (1 << 19) // len(b))
    a, b = a.view(U), b.view(U)  # bits of a signed number are counted without its sign
    found = []
    for start in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(a[start : start + rows, None] ^ b) <= radius)
        found.append((x + start, y))
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    differ = a[x] != b[y]
    x, y = x[differ], y[differ]
    both = np.concatenate([a, b]).view(np.int64)
    if len(x) <= len(both):
        return both[x], both[y + len(a)]
    root = forest(len(both), x, y + len(a))
    return both, both[root]


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 6, parts: int = 1) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the smallest ``doc_id`` reachable over fingerprints within ``radius`` bits.

    NULL and empty texts have fingerprint 0 and are linked like others. Rows that share a ``doc_id`` are
    kept. A NULL ``doc_id`` never gives a component its id, unless no row of the component has one. Other
    columns are not read. ``parts`` is the number of separately counted parts of a fingerprint: more parts
    skip more, at more tiles; use 4 for radii up to 3, else 1.
    """
    steps = Steps(docs.sparkSession, "simhash")
    prints = steps.keep(fingerprints(docs, words))
    roots = components(links(prints, radius, parts, steps), steps)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = placed.join(ids, "root").select("fp", "component_id")
    return prints.join(steps.keep(table), "fp").select("doc_id", "fp", "component_id")


def near_rows(docs: DataFrame, words: int = 5, radius: int = 6, parts: int = 1) -> DataFrame:
    """``(doc_id, text_key, fp, first)`` of every row, for callers that keep one document of each component.

    ``first`` is the ``(no_id, doc_id, text_key)`` of one row of the component of ``near_duplicates``: that of smallest id,
    any id before none, and of smallest ``text_key`` among these. NULL and empty texts have fingerprint 0. Other columns
    are not read.
    """
    steps = Steps(docs.sparkSession, "simhash-rows")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, words)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    prints = steps.keep(keyed.mapInArrow(run, "doc_id long, text_key long, fp long"))
    roots = components(links(prints, radius, parts, steps), steps)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    placed = prints.groupBy("fp").agg(first).join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    table = steps.keep(placed.drop("first").join(firsts, "root").select("fp", "first"))
    return prints.join(table, "fp").select("doc_id", "text_key", "fp", "first")


LANES, NEAR = 4, 2
"""Words of 64 bits of a wide fingerprint, and how many of them are compared first."""

NEAR_BITS, SURE = 38, 0.2
"""Differing bits at most in those first words, and how far an estimate may be below the similarity to be looked at."""

SETS = 256
"""Shingle sets of a tile, on average at most."""


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """``LANES`` fingerprints of distinct shingles, each from its own mix of their hashes."""
    out = []
    for lane in range(LANES):
        x = (hashes + U(lane)) * U(0x9E3779B97F4A7C15) if lane else hashes
        x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9) if lane else x
        out.append(fingerprint(x ^ (x >> U(29)) if lane else x))
    return out


def _alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles whose fingerprints and sizes allow the similarity."""
    rows = max(1, (1 << 19) // len(b))
    a, b = a.view(U), b.view(U)
    found = []
    for start in range(0, len(a), rows):
        part = slice(start, start + rows)
        differ = sum(np.bitwise_count(a[part, None, lane] ^ b[:, lane]) for lane in range(NEAR))
        x, y = np.nonzero(differ <= NEAR_BITS)
        found.append((x + start, y))
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    small, large = np.minimum(na[x], nb[y]), np.maximum(na[x], nb[y])
    bits = np.bitwise_count(a[x] ^ b[y]).sum(axis=1, dtype=np.int64)
    cosine = np.cos(np.pi * bits / (64 * LANES))
    common = cosine * np.sqrt(small * large)
    estimate = common / np.maximum(small + large - common, 1)
    fine = (small >= similarity * large) & ((estimate >= similarity - SURE) | (large == 0))
    return x[fine], y[fine]


def text_key() -> F.Column:
    """What tells rows of one id, or of none, apart: a hash of the text; NULL texts are empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of every row of ``similar_rows``."""
    return similar_rows(docs, words, similarity).select("doc_id", "component_id")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, text_key, component_id, first)``: components of texts whose word shingles have a Jaccard similarity of ``similarity`` or more.

    ``first`` is the ``(no_id, doc_id, text_key)`` of one row of the component: that of smallest id, any id before none,
    and of smallest ``text_key`` among these.

    Fingerprints of several words find candidates; tiles are bands of set sizes here, since sets whose sizes
    differ more than by the similarity cannot be that similar. Candidates form loose groups, and inside these
    the shingle sets are compared exactly, again tile by tile, so every link is one of the sets themselves.
    Texts with the same fingerprint count as copies. NULL and empty texts have no shingles and are alike.
    A NULL ``doc_id`` never names a component unless no row of it has one; other columns are not read.
    """
    steps = Steps(docs.sparkSession, "similar")
    lanes = [f"w{i}" for i in range(LANES)]

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in texts_of(batch.column(1))]
            found = list(zip(*map(wide_fingerprint, sets), strict=True)) or [()] * LANES
            columns = [batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), *[pa.array(f, pa.int64()) for f in found]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", *lanes])

    kinds = "doc_id long, text_key long, n long, " + ", ".join(f"{w} long" for w in lanes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    printed = keyed.mapInArrow(prints, kinds)
    printed = steps.keep(printed.withColumn("fp", F.xxhash64("n", *lanes)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    distinct = printed.groupBy("fp", "n", *lanes).agg(first)
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / float(-np.log(similarity))).cast("int")
    tiles = _tiles(steps.keep(distinct.withColumn("cell", band)), F.struct("fp", "n", *lanes), TILE)
    tiles = steps.keep(tiles)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (fa, na, a), (fb, nb, b) = (_columns(batch.column(j)[i].values) for j in (0, 1))
                x, y = _alike(a, na, b, nb, similarity)
                root = forest(len(fa) + len(fb), x, y + len(fa))
                both = np.append(fa, fb)
                moved = both != both[root]
                yield pa.RecordBatch.from_arrays([pa.array(both[moved]), pa.array(both[root][moved])], ["a", "b"])

    loose = components(_tile_pairs(tiles, (0, 1)).mapInArrow(compare, "a long, b long"), steps)
    roots = loose.select("root").distinct()
    members = steps.keep(loose.union(roots.select(F.col("root").alias("node"), "root")).distinct())
    chosen = distinct.join(members, F.col("fp") == F.col("node")).select("first.doc_id", "first.text_key", "fp", F.col("root").alias("cell"))
    # one text for each fingerprint, by id and text: ids may be missing or shared
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key"), "fp", "cell")
    same = (F.col("text_key") == F.col("chosen_key")) & F.col("doc_id").eqNullSafe(F.col("chosen_id"))
    sets = keyed.join(chosen, same).groupBy("fp", "cell").agg(F.first("text").alias("text"))

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["fp", "cell", "s"])

    hashed = steps.keep(sets.select("fp", "cell", "text").mapInArrow(shingles, "fp long, cell long, s array<long>"))
    groups = steps.keep(_tiles(hashed, F.struct("fp", "s"), SETS))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tiles_of = [batch.column(j)[i].values for j in (0, 1)]
                both = np.concatenate([t.field("fp").to_numpy() for t in tiles_of])
                root = _verified([s for t in tiles_of for s in lists_of(t.field("s"))], len(tiles_of[0]), similarity)
                moved = both != both[root]
                yield pa.RecordBatch.from_arrays([pa.array(both[moved]), pa.array(both[root][moved])], ["a", "b"])

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = _tile_pairs(groups, (0,)).repartition(parts)  # all pairs of a large group would be one task's
    links_found = spread.mapInArrow(verify, "a long, b long")
    classes = components(links_found, steps)
    each = printed.groupBy("fp").agg(first)
    placed = each.join(classes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    table = steps.keep(placed.drop("first").join(firsts, "root").select("fp", "first"))
    return printed.select("doc_id", "text_key", "fp").join(table, "fp").select("doc_id", "text_key", F.col("first.doc_id").alias("component_id"), "first")


def _tiles(rows: DataFrame, item: F.Column, size: int) -> DataFrame:
    """``(cell, tile, items)``: the rows of each cell in tiles of about ``size``."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("in_cell"))
    salted = rows.join(sizes, "cell").withColumn("tile", F.expr(f"pmod(xxhash64(fp), div(in_cell - 1, {size}) + 1)"))
    return salted.groupBy("cell", "tile").agg(F.collect_list(item).alias("items"))


def _tile_pairs(tiles: DataFrame, steps_to: tuple[int, ...]) -> DataFrame:
    """``(a, b)``: each tile with the tiles of its own cell, once, and of the cells so many steps above."""
    here = tiles.select(F.col("cell").alias("at"), F.col("tile").alias("here"), F.col("items").alias("a"))
    there = tiles.select(F.explode(F.array(*map(F.lit, steps_to))).alias("step"), "cell", F.col("tile").alias("there"), F.col("items").alias("b"))
    there = there.select((F.col("cell") - F.col("step")).alias("at"), "step", "there", "b")
    return here.join(there, "at").filter("step <> 0 OR here <= there").select("a", "b")


def _columns(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lanes = np.stack([items.field(f"w{i}").to_numpy() for i in range(LANES)], axis=1)
    return items.field("fp").to_numpy(), items.field("n").to_numpy(), np.ascontiguousarray(lanes)


def _verified(sets: list[np.ndarray], first: int, similarity: float) -> np.ndarray:
    """The smallest node reachable over pairs of sets, one before ``first`` and one from it on (all pairs if the tiles are one).

    A pair that other links connect already is not compared.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    for i in range(first):
        near = np.flatnonzero((np.minimum(size[i], size[first:]) >= similarity * np.maximum(size[i], size[first:]))) + first
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                common = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                    root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])
