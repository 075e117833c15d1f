"""Long byte strings that documents share: maximal repeats from the interval tree of an enhanced suffix array.

1. Anchors. In every window of ``LENGTH`` bytes the 26-byte string of least hash is its anchor, so windows of
   equal content have the same anchor wherever they stand. One anchor serves a run of up to 25 windows.
2. Exchange. Tasks send their anchors, packed into binary blocks, to the bucket of the hash, and anchors
   that stand in two documents come back. An anchor that a task has in several documents is sent once.
3. Segments. Around each shared anchor the text of its windows (at most 74 bytes) is cut out. Equal segments
   are grouped first, with their smallest and largest document, so a passage found in a third of all
   documents is one row.
4. Suffix array. Segments of the same anchors meet in one task, which sorts those of their suffixes that share
   50 bytes with another one, takes the common prefixes of neighbours and scans them with a stack. Each
   interval of the tree whose members differ in the byte to their left is a maximal repeat; all its members
   are its occurrences, not just neighbours. An anchor with more than ``HOT`` segments is taken apart into single windows, grouped by content, instead.
5. Every occurrence outside the smallest document of its repeat is a range to remove.

All windows are compared exactly in step 4; hashes only bring them together. Documents are identified by
their id and text, so rows that repeat are handled alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from blockquery.llm.common import Steps, batches_of, texts_of

LENGTH, ANCHOR = 50, 26
RUN = LENGTH - ANCHOR + 1  # windows that one anchor can serve
LONGEST = LENGTH + RUN - 1  # bytes of a segment
STEP = 1 << 20
POSITION = np.uint64((1 << 21) - 1)
BATCH = 4 << 20
"""Bytes of text whose anchors a task compares before it sends them."""

HOT = 20_000
"""Distinct segments of one anchor that a task may sort."""

U = np.uint64
_RANDOM = np.random.default_rng(50)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the 26 bytes from each position on."""

    def power(n: int) -> np.uint64:
        return U(pow(FACTOR, n, 1 << 64))

    two = BYTE[data]
    two = two[:-1] * power(1) + two[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    n = len(data) - ANCHOR + 1
    return _mix((sixteen[:n] * power(8) + eight[16 : 16 + n]) * power(2) + two[24 : 24 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, windows before the anchor's first one, and number of windows, of all anchors of texts laid end to end."""
    out: list[tuple] = []
    for base in range(0, len(data) - LENGTH + 1, STEP):
        part = data[base : base + STEP + LENGTH - 1]
        hashes = _hashes(part)
        low = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        for n in (1, 2, 4, 8):
            low = np.minimum(low[:-n], low[n:])
        low = np.minimum(low[: -(RUN - 16)], low[RUN - 16 :])  # of 25 positions
        at = (low & POSITION).astype(np.int64)
        starts = np.arange(base, base + len(at))
        document = np.searchsorted(ends, starts, side="right")
        inside = starts + LENGTH <= ends[document]
        starts, at, document = starts[inside], at[inside], document[inside]
        if len(at):
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
            count = np.diff(np.append(first, len(at)))
            out.append((_mix(hashes[at[first]] * U(FACTOR)), at[first] + base, at[first] + base - starts[first], count))
    if not out:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


BLOCK = "bucket int, data binary"
ONE, SENT_ONCE, FOUND = 0, 1, 2
# columns of a block: hash, document, key, position, windows before and in all, flag
KINDS = (np.uint32, np.int64, np.int64, np.int64, np.uint16, np.uint8)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as compressed bytes; documents, keys and positions as differences, which are small or zero."""
    packed = [np.diff(c, prepend=0) if k is np.int64 else c for c, k in zip(columns, KINDS, strict=True)]
    raw = b"".join(np.ascontiguousarray(c.astype(k, copy=False).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, k in zip(packed, KINDS, strict=True))
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(raw)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:]), 0, []
    for kind in KINDS:
        width = np.dtype(kind).itemsize
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
        at += n * width
        out.append(np.cumsum(c) if kind is np.int64 else c)
    return out


def _blocks(labels: list[int]):  # noqa: ANN202
    """Rows of ``(doc_id, key, text)`` to blocks of anchors by bucket; ``labels`` are the buckets' values."""
    buckets = len(labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, BATCH, "text"):
            texts = texts_of(batch.column(2))
            lengths = np.array([len(t) for t in texts])
            ends = np.cumsum(lengths)
            h, pos, left, count = anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
            if not len(h):
                continue
            of = np.searchsorted(ends, pos, side="right")
            doc, key = (c.to_numpy(zero_copy_only=False)[of] for c in batch.columns[:2])
            pos = pos - (ends - lengths)[of]
            order = np.argsort(h, kind="stable")
            group = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            shared = np.minimum.reduceat(doc[order], group) != np.maximum.reduceat(doc[order], group)
            flag = np.zeros(len(h), np.uint8)
            flag[order] = np.where(np.repeat(shared, np.diff(np.append(group, len(h)))), FOUND, ONE)
            bucket = ((h >> U(32)) % U(buckets)).astype(np.int64)
            bucket[flag == FOUND] = of[flag == FOUND] % buckets  # known: anywhere, all of a text together
            once = order[group[shared]]
            home = ((h[once] >> U(32)) % U(buckets)).astype(np.int64)
            columns = [np.append(c, c[once]) for c in (h & U(0xFFFFFFFF), doc, key, pos, left * 256 + count, flag)]
            columns[5][len(h) :] = SENT_ONCE
            bucket = np.append(bucket, home)
            order = np.argsort(bucket, kind="stable")
            columns = [c[order] for c in columns]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            filled = np.flatnonzero(np.diff(cuts)).tolist()
            data = [_pack([c[cuts[b] : cuts[b + 1]] for c in columns]) for b in filled]
            yield pa.RecordBatch.from_arrays([pa.array([labels[b] for b in filled], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    return run


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """A value for each partition that a hash repartition into ``parts`` sends there."""
    found: dict[int, int] = {}
    n = 16 * parts
    while len(found) < parts:
        ids = spark.range(n).select(F.col("id").cast("int").alias("label"))
        rows = ids.groupBy(F.pmod(F.hash("label"), F.lit(parts)).alias("place")).agg(F.min("label").alias("label")).collect()
        found, n = {r.place: r.label for r in rows}, 2 * n
    return [found[k] for k in range(parts)]


def _shared(labels: list[int]):  # noqa: ANN202
    """Blocks of a partition to blocks of the places of anchors that stand in two documents, one for each part of the keys.

    ``labels`` are the parts' values. A task makes a row for a part, however many texts go there.
    """
    parts = len(labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        h, doc, key, pos, span, flag = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        keep = flag == FOUND
        rest = np.flatnonzero(~keep)
        order = rest[np.argsort(h[rest], kind="stable")]
        if len(order):
            sorted_h = h[order]
            group = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1]))
            two = np.minimum.reduceat(doc[order], group) != np.maximum.reduceat(doc[order], group)
            two |= np.maximum.reduceat(flag[order], group) == SENT_ONCE
            keep[order] = np.repeat(two, np.diff(np.append(group, len(order))))
        keep &= flag != SENT_ONCE
        key, pos, span = key[keep], pos[keep].astype(np.uint32), span[keep]
        part = key % parts
        order = np.lexsort([key, part])
        key, pos, span, part = key[order], pos[order], span[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        pack = zstandard.ZstdCompressor(1).compress
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            data = (b - a).astype("<i8").tobytes() + pack(b"".join(c[a:b].tobytes() for c in (key, pos, span)))
            yield pa.RecordBatch.from_arrays([pa.array([labels[p]], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])

    return run


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of places of a part of the keys to ``(key, pos, span)``, one row a key."""
    blocks = []
    for data in (x for batch in batches for x in batch.column(1).to_pylist()):
        n, raw = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:])
        blocks.append([np.frombuffer(raw, k, n, n * at) for k, at in ((np.int64, 0), (np.uint32, 8), (np.uint16, 12))])
    if not blocks:
        return
    key, pos, span = (np.concatenate(c) for c in zip(*blocks, strict=True))
    del blocks
    order = np.argsort(key, kind="stable")
    key, pos, span = key[order], pos[order], span[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], len(key))
    for i in range(0, len(first), 1 << 14):
        cuts = list(zip(first[i : i + (1 << 14)].tolist(), last[i : i + (1 << 14)].tolist(), strict=True))
        arrays = [pa.array(key[first[i : i + (1 << 14)]]), *[pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in (pos, span)]]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "pos", "span"])


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, key, text, pos, span)`` to the segments around the places."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches_of(batches, BATCH // 2, "text"):
        docs, keys, texts, pos, span = (c.to_pylist() if i != 2 else texts_of(c) for i, c in enumerate(batch.columns))
        out: list[list] = [[], [], [], [], []]
        for doc, key, text, p, s in zip(docs, keys, texts, pos, span, strict=True):
            at, spans = np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(s, np.uint16).astype(np.int64)
            left = spans >> 8
            start = at - left
            out[0].append(np.full(len(at), doc))
            out[1].append(np.full(len(at), key))
            out[2].append(start)
            out[3].append(left)
            ends = start + (spans & 255) + LENGTH - 1
            out[4] += [text[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out[:4]]
        arrays = [*[pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=False)], pa.array(out[4], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "start", "left", "segment"])


def maximal_repeats(segments: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences ``(segment, offset, length, smallest document)`` of the maximal repeats of segments.

    ``least`` and ``most`` are the smallest and largest document of each segment (the segments are distinct).
    Repeats that stand in one document only are left out.
    """
    width = LONGEST + 6  # room for the last word of the last suffix of a segment
    flat = np.zeros(len(segments) * width + 80, np.uint8)
    lengths = np.array([len(s) for s in segments])
    flat[np.repeat(np.arange(len(segments)) * width - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = np.frombuffer(b"".join(segments), np.uint8)
    words = np.zeros(len(flat) - 7, np.uint64)
    for k in range(8):
        words |= flat[k : len(flat) - 7 + k].astype(np.uint64) << U(56 - 8 * k)
    masks = np.array([0, *[(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)]], np.uint64)  # of the first k bytes
    windows = lengths - LENGTH + 1
    of = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = of * width + offset
    # suffix array: suffixes that share their first 50 bytes are brought together by a hash of these, and only
    # those are ordered by what follows, then by length; no interval of interest spans two hashes
    parts = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    h = np.zeros(len(at), np.uint64)
    for j in parts:
        h += _mix(words[at + j] + U(j)) * U(pow(FACTOR, j + 1, 1 << 64))
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    order = order[np.append(again, False) | np.append(False, again)] if len(order) else order
    h, of, offset, at = h[order], of[order], offset[order], at[order]
    room = lengths[of] - offset
    keys = [words[at + j] & masks[np.clip(room - j, 0, 8)] for j in range(LENGTH, LONGEST, 8)]
    order = np.lexsort([room, *reversed(keys), h])
    h, of, offset, at, room = h[order], of[order], offset[order], at[order], room[order]
    # common prefixes of neighbours, by their bytes
    common = np.zeros(len(at), np.int64)
    going = np.flatnonzero(h[1:] == h[:-1]) + 1
    for j in parts:
        going = going[words[at[going] + j] == words[at[going - 1] + j]]
    common[going] = LENGTH
    for key in keys:
        differ = key[order[going]] ^ key[order[going - 1]]
        same = np.full(len(going), 8)
        for byte in range(8, 0, -1):
            same[(differ >> U(64 - 8 * byte)) != 0] = byte - 1
        common[going] += same
        going = going[same == 8]
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    before = np.where(offset > 0, flat[at - 1].astype(np.int64), -1)
    turns = np.cumsum(np.append(False, (before[1:] != before[:-1]))) if len(before) else np.empty(0, np.int64)
    open_left = np.cumsum(before < 0)
    low, high = least[of], most[of]

    def diverse(a: int, b: int) -> bool:
        return turns[b] != turns[a] or open_left[b] != open_left[a] or before[a] < 0

    found: list[tuple[int, int, int, int]] = []  # first, last, length, smallest document
    borders = np.flatnonzero(common < LENGTH)
    sizes = np.diff(np.append(borders, len(common)))
    several = borders[sizes > 1]
    counts = sizes[sizes > 1]
    if len(borders):
        two = np.minimum.reduceat(low, borders)[sizes > 1] != np.maximum.reduceat(high, borders)[sizes > 1]
        several, counts = several[two], counts[two]
    for first, size in zip(several.tolist(), counts.tolist(), strict=True):
        prefix = common[first : first + size].tolist()
        prefix[0] = 0
        documents = low[first : first + size].tolist()
        stack: list[list[int]] = []  # length, first, smallest document so far
        for i in range(1, size + 1):
            here = prefix[i] if i < size else 0
            left, least_seen = i - 1, documents[i - 1]
            while stack and stack[-1][0] > here:
                length, left, least_here = stack.pop()
                least_seen = min(least_seen, least_here)
                if diverse(first + left, first + i - 1):
                    found.append((first + left, first + i - 1, length, least_seen))
            if stack and stack[-1][0] == here:
                stack[-1][2] = min(stack[-1][2], least_seen)
            elif here:
                stack.append([here, left, least_seen])
    # segments that stand in several documents are repeats as they are
    alone = np.flatnonzero(least != most)
    if not found:
        return alone, np.zeros(len(alone), np.int64), lengths[alone], least[alone]
    a, b, length, document = (np.array(x) for x in zip(*found, strict=True))
    n = b - a + 1
    member = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = [of[member], offset[member], np.repeat(length, n), np.repeat(document, n)]
    useful = most[out[0]] > out[3]
    extra = [alone, np.zeros(len(alone), np.int64), lengths[alone], least[alone]]
    return tuple(np.append(x[useful], y) for x, y in zip(out, extra, strict=True))


RANGES = "k1 long, k2 long, ranges array<struct<offset: int, length: int, document: long>>"
GROUP = 20_000
"""Segments whose suffixes are sorted together; an anchor is never split."""


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a partition to ranges of offset, length and smallest document."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.sort_by("anchor")
    anchor = table.column("anchor").to_numpy()
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    cuts, last = [0], 0
    for start in starts.tolist():
        if start - last >= GROUP:
            cuts.append(start)
            last = start
    for a, b in zip(cuts, [*cuts[1:], len(anchor)], strict=True):
        part = table.slice(a, b - a)
        k1, k2, least, most = (part.column(c).to_numpy() for c in ("k1", "k2", "least", "most"))
        found = maximal_repeats(part.column("segment").to_pylist(), least, most)
        order = np.argsort(found[0], kind="stable")
        of, offset, length, document = (x[order] for x in found)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(offset.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(document)], ["offset", "length", "document"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), entries)
        yield pa.RecordBatch.from_arrays([pa.array(k1[of[first]]), pa.array(k2[of[first]]), lists], ["k1", "k2", "ranges"])


def shared_ranges(docs: DataFrame) -> DataFrame:
    """``(key, ranges)``: for each document, ``(start, end)`` of the bytes that a smaller document has in a common string.

    ``docs`` has ``doc_id``, ``key`` (an id of the row's id and text) and ``text``; rows without a ``doc_id`` take
    no part. A text that a smaller document has as a whole goes as a whole, and is not cut into segments.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "repeats")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.filter("doc_id IS NOT NULL").filter(F.octet_length("text") >= LENGTH)
    content = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), F.octet_length("text").alias("n")]
    texts = steps.keep(named.select("doc_id", "key", *content))
    first = texts.groupBy("t1", "t2", "n").agg(F.min("doc_id").alias("first"))
    copies = steps.keep(texts.join(first, ["t1", "t2", "n"]).filter(F.col("doc_id") > F.col("first")).select("key", "n").distinct())
    labels = _labels(spark, parts)
    blocks = named.select("doc_id", "key", "text").mapInArrow(_blocks(labels), BLOCK)
    places = blocks.repartition(parts, "bucket").mapInArrow(_shared(labels), BLOCK)
    grouped = steps.keep(places.repartition(parts, "bucket").mapInArrow(_gathered, "key long, pos binary, span binary"))
    at = grouped.join(copies, "key", "left_anti")
    cut = named.join(at, "key").select("doc_id", "key", "text", "pos", "span")
    cut = cut.mapInArrow(_segments, "doc_id long, key long, start int, left int, segment binary")
    cut = cut.withColumns({"k1": F.xxhash64("segment"), "k2": F.xxhash64(F.lit(50), "segment")})
    cut = steps.keep(cut)
    steps.drop(texts, grouped)
    distinct = cut.groupBy("k1", "k2", "segment", "left").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    distinct = steps.keep(distinct.withColumn("anchor", F.xxhash64(F.expr(f"substring(segment, left + 1, {ANCHOR})"))))
    hot = steps.keep(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"))
    some_hot = not hot.isEmpty()
    cold = distinct.join(hot, "anchor", "left_anti") if some_hot else distinct
    ranges = cold.repartition(parts, "anchor").select("k1", "k2", "segment", "least", "most", "anchor").mapInArrow(_ranges, RANGES)
    if some_hot:
        window = F.explode(F.expr(f"sequence(0, octet_length(segment) - {LENGTH})"))
        windows = distinct.join(hot, "anchor", "left_semi").select("k1", "k2", "least", "most", "segment", window.alias("offset"))
        windows = windows.withColumn("content", F.expr(f"substring(segment, offset + 1, {LENGTH})")).drop("segment")
        seen = windows.groupBy("content").agg(F.min("least").alias("document"), F.max("most").alias("last")).filter("document < last")
        single = windows.join(seen, "content").filter("most > document")
        single = single.select("k1", "k2", F.struct("offset", F.lit(LENGTH).alias("length"), "document").alias("r"))
        ranges = ranges.union(single.groupBy("k1", "k2").agg(F.collect_list("r").alias("ranges")))
    by_segment = steps.keep(ranges)
    found = cut.select("doc_id", "key", "start", "k1", "k2").join(by_segment, ["k1", "k2"])
    mine = F.filter("ranges", lambda r: r["document"] < F.col("doc_id"))
    place = F.transform(mine, lambda r: F.struct((F.col("start") + r["offset"]).alias("start"), (F.col("start") + r["offset"] + r["length"]).alias("end")))
    each = found.select("key", F.explode(place).alias("r"))
    whole = copies.select("key", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("ranges"))
    out = steps.keep(each.groupBy("key").agg(F.collect_list("r").alias("ranges")).union(whole))
    steps.drop(cut, distinct, by_segment, copies)
    return out


def merged(ranges: pa.ListArray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end)`` of the ranges of each row as disjoint runs in order; runs that touch are one. NULL has none."""
    of = np.repeat(np.arange(rows), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in ranges.flatten().flatten())
    if not len(of):
        return of, start, end
    order = np.lexsort([start, of])
    of, start, end = of[order], start[order], end[order]
    lift = of * (int(end.max()) + 2)  # rows apart by more than any range reaches
    reached = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(np.append(True, (start + lift)[1:] > reached[:-1]))
    last = np.append(first[1:], len(of)) - 1
    return of[first], start[first], reached[last] - lift[last]


def without_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``_kept`` (bytes that stay), ``_n_removed`` and ``_n_spans`` for each text.

    With ``as_text``, ``_kept`` is a text, without the characters of which a part is removed.

    A byte goes if a string of 50 bytes that covers it also starts in a row of smaller ``doc_id``. NULL texts
    are empty; texts below 50 bytes, rows without an id, and repeats within one id lose nothing. Rows that
    repeat each other are treated alike. All rows and columns stay; strings are judged on the input.
    """
    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64("doc_id", text, F.reverse(text)).alias("key"))
    joined = rows.join(shared_ranges(rows.select("doc_id", "key", "text")), "key", "left").select("doc", "text", "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, end = merged(batch.column(2), batch.num_rows)
            removed = np.bincount(of, end - start, batch.num_rows).astype(np.int64)
            spans = np.bincount(of, minlength=batch.num_rows)
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            start, end, kept = start.tolist(), end.tolist(), []
            for content, a, b in zip(texts_of(batch.column(1)), cuts, cuts[1:], strict=False):
                kept.append(b"".join(content[x:y] for x, y in zip([0, *end[a:b]], [*start[a:b], len(content)], strict=True)) if a < b else content)
            kept = [k.decode(errors="ignore") for k in kept] if as_text else kept
            added = [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], ["doc", "_kept", "_n_removed", "_n_spans"])

    kinds = StructType([StructField("doc", docs.schema)]).add("_kept", "string" if as_text else "binary").add("_n_removed", "long").add("_n_spans", "long")
    return joined.mapInArrow(run, kinds).select("doc.*", "_kept", "_n_removed", "_n_spans")
