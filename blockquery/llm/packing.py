"""Best-fit packing of token sequences with certified bin counts.

Texts become token ids, documents longer than a sequence are cut, and the pieces are dealt evenly to
partitions of bounded size. Each partition packs by best-fit decreasing and compares its bin count with a
lower bound from dual-feasible functions: a partition that meets its bound is certified. Partitions with a
gap give the pieces of their bins that are not full to an exchange, where they are mixed into fewer
partitions and packed again; a partition of the exchange that needs no fewer sequences than its pieces had
before would still be right, and the whole round is dropped if it saves none. Rounds go on until all is
certified, or a round saves no sequence.

No task sees more than a partition of pieces, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockquery.llm.common import Steps, batches_of, texts_of, without_cycle_search

SHARE = 60_000
"""Pieces of a partition."""

KNOWN_WORDS = 1 << 19
"""Words whose ids a worker process remembers, from task to task, before it starts anew."""

JOINED = 64
"""Words of plain letters that the tokenizer gets as one text."""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, fill long, certified boolean"


@cache
def _tokenizer(path: str, plain: bool) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain  # strings of added tokens in a text are then ordinary text
    return tokenizer


@cache
def _ends(path: str) -> np.ndarray:
    """Which ids are tokens that end a word."""
    vocabulary = _tokenizer(path, True).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return out


STOPS = b".,!?;:%*$#&"


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """A word in lower case as its stem and the stops after it, where a letter or digit ends the stem.

    The tokenizer lowers case, and never joins a letter or digit with what is none, so both parts have the
    ids they have together.
    """
    low = word.lower()
    stem = low.rstrip(STOPS)
    # a letter whose lower case ends in a mark, as that of U+0130 does, is joined with what follows
    if stem and len(stem) < len(low) and (stem[-1] < 128 and stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode()[-1].lower()[-1].isalpha()):
        return stem, low[len(stem) :]
    return low, b""


class WordIds:
    """Token ids of texts by way of their distinct words; tokens never cross white space.

    A word's ids are kept as the bytes of little-endian unsigned 32-bit numbers, so those of a text are the bytes of its words joined.

    With ``plain``, strings of added tokens in a text are ordinary text; else they are those tokens, in their own case only.
    """

    def __init__(self, path: str, plain: bool = True):
        self.tokenizer = _tokenizer(path, plain)
        contents = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = () if plain else tuple(contents)
        # only an added token of plain letters can be found inside a word of plain letters
        self.ends = None if any(c.isalpha() for c in contents) else _ends(path)
        self.clear()

    def _parts(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        low = b"\n".join(words).lower()
        added = [a for a in self.added if a in low]  # seldom any
        return [(w, b"") if added and any(a in w.lower() for a in added) else _stem(w) if w[-1] in STOPS else (w.lower(), b"") for w in words]

    def clear(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {b"": b""}

    def _coded(self, stems: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Stems and their ids. A stem of plain letters has one token that ends a word, its last, so many can be encoded as one text."""
        letters = [w for w in stems if w.isalpha()] if self.ends is not None else []
        flat, _ = self._encoded([b" ".join(letters[i : i + JOINED]) for i in range(0, len(letters), JOINED)])
        cuts = np.flatnonzero(self.ends[flat]) + 1 if letters else np.empty(0, np.int64)
        if len(cuts) != len(letters):  # a tokenizer that does not mark the ends of words
            letters, cuts, flat = [], cuts[:0], flat[:0]
        one_by_one = [w for w in stems if not w.isalpha()] if letters else stems
        rest, more = self._encoded(one_by_one)
        ends = [0, *(4 * np.append(cuts, len(flat) + more)).tolist()]
        data = flat.tobytes() + rest.tobytes()
        return zip(letters + one_by_one, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each text ends."""
        ids = [c.ids for c in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter(chain.from_iterable(ids), "<u4"), ends

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.clear()
        words_of = [t.split() for t in texts]
        if fresh := list(set().union(*words_of).difference(self.known)):
            parts = self._parts(fresh)
            new = list(set(chain.from_iterable(parts)).difference(self.stems))
            self.stems.update(self._coded(new))
            stems = self.stems
            self.known.update(zip(fresh, [stems[stem] + stems[stops] if stops else stems[stem] for stem, stops in parts], strict=True))
        for words in words_of:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


@cache
def known_words(path: str, plain: bool) -> WordIds:
    """The words that this worker process knows already."""
    return WordIds(path, plain)


def pieces(docs: DataFrame, path: str, size: int, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut only if longer than ``size``.

    Ids are those of the library's defaults without special tokens around a text; the string of an added token in a
    text is that token. NULL and empty texts are one piece of ``end_id``. Repeated rows and NULL ids give pieces of their own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(path, False)

        @without_cycle_search
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts_of(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        yield from map(cut, batches_of(batches, 4 << 20, "text"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that any packing needs, from dual-feasible functions over counts by length (index 0 to ``size``).

    Each function keeps every set of lengths that fits into a bin within one: lengths over ``size - a`` count
    as a whole bin and those below ``a`` as none, for each ``a``; and lengths rounded down to multiples of
    ``1 / k`` in a way that rewards lengths just over a fraction of the bin.
    """
    x = np.arange(size + 1)
    share = x / size
    best = (counts * share).sum()
    for a in range(1, size // 2 + 1):
        f = counts[size - a + 1 :].sum() + (counts[a : size - a + 1] * share[a : size - a + 1]).sum()
        best = max(best, f)
    for k in range(1, 21):
        scaled = (k + 1) * x
        f = np.where(scaled % size == 0, share, scaled // size / k)
        best = max(best, (counts * f).sum())
    return int(np.ceil(best - 1e-6))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (sorted from long to short), and the filled length of each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by the room left
    rooms = 0  # bit r: some bin has room r
    fill: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, size - room
        fill[b] += n
        if left := room - n:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _packed(dealt: DataFrame, size: int, turn: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32"))])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, size)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=size + 1), size)
        base = ((turn << 32) + TaskContext.get().partitionId()) << 24
        added = {"sequence_id": base + bins, "offset": offsets, "fill": fill[bins], "certified": np.full(len(bins), certified)}
        for name, values in added.items():
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(run, PACKED)


def pack(cut: DataFrame, size: int) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, none longer than ``size``.

    ``cut`` is what ``pieces`` returns; an empty one gives none.
    """
    steps = Steps(cut.sparkSession, "packing")
    todo = steps.keep(cut)
    done: list[DataFrame] = []
    turn, before, rows = 0, None, todo.count()
    while rows:
        packed = steps.keep(_packed(todo.repartition(-(-rows // SHARE)), size, turn))
        free = (F.col("fill") < size) & ~F.col("certified")
        sequences, rows, used = packed.agg(F.count_if(F.col("offset") == 0), F.count_if(free), F.count_if(free & (F.col("offset") == 0))).first()
        if before is not None and sequences >= before[1]:  # the exchange saved none: what stood before stays
            done.append(before[0])
            break
        done.append(packed.filter(~free))
        todo, before, turn = packed.filter(free), (packed.filter(free), used), turn + 1
    out = [d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset") for d in done]
    if not out:
        return todo.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for other in out[1:]:
        out[0] = out[0].union(other)
    return out[0]
