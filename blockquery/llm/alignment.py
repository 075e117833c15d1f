"""Alignment of the tokens of two tokenizers over the same bytes.

Each text is encoded by both tokenizers. In a batch, the tokens of each side are a table of ``(doc, start)``,
and ``pandas.merge_asof``, keyed by document, finds for the start of each token the token of the other side
that covers it. Two tokens overlap exactly if one of them holds the start of the other, so the union of both
directions is the list of links. Bytes where tokens of both sides end cut the text into groups.

How often two ids are linked in the whole corpus is counted in steps. Texts come in chunks of bounded size; a
chunk keeps its distinct id pairs and their counts once, and each text the places of its pairs in that list.
Spark adds the counts up by pair, finds the highest count of each id of the second side (no more rows
than its vocabulary has ids, so that table may be broadcast), and joins both back to the chunk lists. A
pair that stands in every text is one row a chunk. Chunk lists and texts meet again by chunk, which is as large
as a chunk and no larger, whatever a key's share is.

Both tokenizers cut before a white space character that follows another character, unless a piece of the second one
joins the two; words cut there are encoded once a task, and texts are put together from them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockquery.llm.common import Steps, batches_of

BATCH = 1 << 20
"""Bytes of text of one merge, or one text."""

CHUNK = 8 << 20
"""Bytes of text of a chunk, or one text."""

KNOWN_WORDS = 1 << 18
"""Words whose tokens a task remembers before it starts anew."""

TOGETHER = 500
"""Words that are encoded as one text."""

CHUNKS = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "distinct array<long>, places binary, times binary, pairs array<long>, counts array<long>"
)
TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
LOW = (1 << 32) - 1


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by rule: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the tokens of words met before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_character = byte_characters()
        entries = {i: bytes(map(of_character.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space_b = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        # a piece must neither join a space to what is before it, nor another one to the space that the library puts before a text
        joined = {y for p in pieces for x, y in zip(p, p[1:]) if y.isspace() and (not x.isspace() or x == " " != y)}
        cuts = "".join(c for c in " \n\t" if c not in joined)
        # white space, and what follows up to a place where both tokenizers cut
        self.words = re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S+)*(?:[^\S{cuts}]\s*)?|\s+" if cuts else r"(?s).+").findall
        self.written = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sides = [Tokens(self.bytes_a), Tokens(self.bytes_b)]
        self.whole = np.empty(0, bool)

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text as they are inside a longer one. The library puts a space before, in place of the text's own."""
        coded = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [c or [self.space_b] if t[0] == " " else c[1:] for t, c in zip(texts, coded, strict=True)]

    def places(self, words: set[str]) -> None:
        """Remember the tokens of words.

        Both tokenizers cut between two words unless the first ends in white space, so many are encoded as one text.
        """
        fresh = list(words.difference(self.known))
        if fresh:
            apart = [[w] for w in fresh if w[-1].isspace()]
            joint = [w for w in fresh if not w[-1].isspace()]
            groups = [joint[i : i + TOGETHER] for i in range(0, len(joint), TOGETHER)] + apart
            self._add(groups)

    def _add(self, groups: list[list[str]]) -> None:
        texts = ["".join(g) for g in groups]
        ids_a = [c.ids for c in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        again = []
        for words, text, *ids in zip(groups, texts, ids_a, self._ids_b(texts), strict=True):
            whole = all(b"".join(map(side.spelled.__getitem__, i)) == text.encode() for side, i in zip(self.sides, ids, strict=True))
            if whole or len(words) == 1:
                self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
                self.whole = np.append(self.whole, np.full(len(words), whole))
                ends = np.cumsum([len(w.encode()) for w in words])
                for side, i in zip(self.sides, ids, strict=True):
                    side.add(np.array(i, np.int64), ends)
            else:
                again += [[w] for w in words]  # one of them is not spelled out again
        if again:
            self._add(again)


class Tokens:
    """Ids of the tokens of words on one side, by number of the word. Room grows by doubling."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled, self.sizes = spelled, np.array(list(map(len, spelled)), np.int64)
        self.ids, self.starts, self.counts = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.used = self.words = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Tokens of some words, which end at the bytes ``ends``. What is not spelled out again belongs to a single word."""
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right") if len(ends) > 1 else np.array([len(ids)])
        words, used = self.words + len(ends), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.append(self.ids, np.empty(used, np.int64))
        if words > len(self.starts):
            self.starts, self.counts = (np.append(x, np.empty(words, np.int64)) for x in (self.starts, self.counts))
        self.ids[self.used : used] = ids
        self.counts[self.words : words] = np.diff(upto, prepend=0)
        self.starts[self.words : words] = self.used + upto - self.counts[self.words : words]
        self.words, self.used = words, used

    def of(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, id and byte length of each token of the words ``at``, whose documents are ``doc``."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        places = np.repeat(self.starts[at] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.ids[places]
        return np.repeat(doc, counts), ids, self.sizes[ids]


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all tokens that share bytes.

    Both are ``(doc, start)`` with starts that go on growing from one document to the next.
    """
    a = a.assign(in_a=np.arange(len(a)), start_a=a["start"])
    b = b.assign(in_b=np.arange(len(b)))
    of_a = pd.merge_asof(a, b, on="start", by="doc")
    of_b = pd.merge_asof(b, a, on="start", by="doc")
    new = of_b["start"].to_numpy() != of_b["start_a"].to_numpy()  # tokens that start together are found from both sides
    return (
        np.concatenate([of_a["in_a"].to_numpy(), of_b["in_a"].to_numpy()[new]]),
        np.concatenate([of_a["in_b"].to_numpy(), of_b["in_b"].to_numpy()[new]]),
    )


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, from 0: a group ends where tokens of both sides end."""
    near = np.searchsorted(ends_b, ends_a)  # both end at the same byte, so none is beyond
    common = ends_a[ends_b[near] == ends_a]
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def written_groups(pair: Pair, ids: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The tokens of both sides as text in the order of groups: commas within a side, a bar after a, a semicolon after b."""
    n = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    sizes = [np.bincount(g, minlength=n) for g in groups]
    before_b = np.cumsum(sizes[1]) - sizes[1]
    places = [np.arange(len(ids[0])) + before_b[groups[0]], np.arange(len(ids[1])) + np.cumsum(sizes[0])[groups[1]]]
    marked = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side in (0, 1):
        last = np.append(np.diff(groups[side]) != 0, True) if len(groups[side]) else np.empty(0, bool)
        marked[places[side]] = ids[side] * 3 + np.where(last, 1 + side, 0)
    return list(map(pair.written.__getitem__, marked.tolist()))


def aligned(pair: Pair, texts: list[str | None], digest: bool) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Of a batch of texts: tokens of both sides, groups and links of each, its groups as text, and all links by text and pair of ids."""
    if len(pair.known) > KNOWN_WORDS:
        pair.clear()
    n = len(texts)
    words_of = [pair.words(" " + t) if t else [] for t in texts]
    pair.places(set().union(*words_of))
    at = np.fromiter(map(pair.known.__getitem__, chain.from_iterable(words_of)), np.int64)
    doc = np.repeat(np.arange(n), list(map(len, words_of)))
    whole = np.bincount(doc, ~pair.whole[at], n) == 0  # texts that both sides spell out again
    at, doc = at[whole[doc]], doc[whole[doc]]
    (doc_a, ids_a, size_a), (doc_b, ids_b, size_b) = (tokens.of(at, doc) for tokens in pair.sides)
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)  # the same bytes on both sides, so places agree over the batch
    in_a, in_b = overlaps(pd.DataFrame({"doc": doc_a, "start": ends_a - size_a}), pd.DataFrame({"doc": doc_b, "start": ends_b - size_b}))
    groups = grouped(ends_a, ends_b)
    closes = np.append(np.diff(groups[0]) != 0, True) if len(doc_a) else np.empty(0, bool)
    counts = [np.bincount(d, minlength=n) for d in (doc_a, doc_b, doc_a[closes], doc_a[in_a])]
    marks = written_groups(pair, [ids_a, ids_b], groups)
    upto = np.cumsum(counts[0] + counts[1]).tolist()
    said = ["".join(marks[a:b])[:-1] for a, b in zip([0, *upto], upto)]
    if digest:
        said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
    return counts, said, doc_a[in_a], (ids_a[in_a] << 32) + ids_b[in_b]


class Chunk:
    """Texts of one chunk, and the links among their tokens."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[list[np.ndarray]] = []
        self.groups: list[str] = []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list[int | None], found: tuple, size: int) -> None:
        counts, groups, doc, pairs = found
        self.links.append((doc + len(self.ids), pairs))
        self.ids += ids
        self.groups += groups
        self.counts.append(counts)
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        doc, pairs = (np.concatenate(x) for x in zip(*self.links, strict=True))
        place, pairs = pd.factorize(pairs, sort=True)
        n = np.bincount(place, minlength=len(pairs))
        each, keys = pd.factorize(doc * max(len(pairs), 1) + place)
        order = np.argsort(keys)
        times = np.bincount(each, minlength=len(keys))[order]
        doc, place = np.divmod(keys[order], max(len(pairs), 1))
        packer = zstandard.ZstdCompressor(level=3)
        packed = [packer.compress(np.diff(x, prepend=0).astype("<i4").tobytes()) for x in (place, times)]
        counts = [np.concatenate(c) for c in zip(*self.counts, strict=True)]
        lists = [self.ids, *counts, self.groups, np.bincount(doc, minlength=len(self.ids)), *packed, pairs, n]
        kinds = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 2
        columns = [pa.array([number], pa.int64()), *(pa.array([x], k) for x, k in zip(lists, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4"), dtype=np.int64)


def chunks(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """One row a chunk of texts: what holds for each text alone, and the distinct pairs of ids with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches_of(batches, BATCH, "text"):
            chunk.add(batch.column(0).to_pylist(), aligned(pair, batch.column(1).to_pylist(), digest), batch.column(1).nbytes)
            if chunk.size >= CHUNK:
                yield chunk.row(number)
                number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield chunk.row(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS)


def _judged(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one chunk with what the corpus says about their links."""
    row = {c: texts.column(c)[0].as_py() for c in ("distinct", "places", "times")}
    n = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, np.int64)
    at = pairs.column("place").to_numpy()
    n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    place, times = _unpacked(row["places"]), _unpacked(row["times"])
    ends = np.cumsum(np.array(row["distinct"], np.int64))
    sums = [np.concatenate([[0], np.cumsum(times * x[place])]) for x in (best, n)]
    starts = ends - np.array(row["distinct"], np.int64)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [texts.column(c).combine_chunks().flatten() for c in names]
    columns += [pa.array(s[ends] - s[starts]) for s in sums]
    return pa.table([*columns, texts.column("groups").combine_chunks().flatten()], [*names, "n_best", "count_sum", "groups"])


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of every row.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a piece model that puts a space before a text; both encode a
    space and the text. ``groups`` holds the ids of both sides group by group, ``a,a|b;a|b,b``, or with ``digest`` the
    SHA-256 of that, which saves the room of the text between the steps. ``n_best`` counts links whose pair of ids is linked
    most often of all pairs of its second id in the corpus, ties included; ``count_sum`` adds up how often they are linked.

    Texts that are NULL, empty, or not spelled out again by one of the tokenizers have no tokens: zeros and empty groups.
    Long texts are a chunk of their own; a word without white space is encoded whole. Repeated rows
    and NULL ids count like others, other columns are not read, and an empty table gives no rows.
    """
    steps = Steps(docs.sparkSession, "alignment")
    kept = steps.keep(chunks(docs, path_a, path_b, digest))
    pairs = kept.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "pair")).select("of", "place", "pair.*")
    total = steps.keep(pairs.groupBy("pairs").agg(F.sum("counts").alias("n")))
    second = F.col("pairs").bitwiseAND(LOW)
    # one row an id of the second vocabulary at most
    highest = total.groupBy(second.alias("second")).agg(F.max("n").alias("highest"))
    judged = total.withColumn("second", second).join(F.broadcast(highest), "second")
    looked = pairs.join(judged.select("pairs", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")), "pairs")
    texts = kept.drop("pairs", "counts").groupBy("chunk")
    return texts.cogroup(looked.select("of", "place", "n", "best").groupBy("of")).applyInArrow(_judged, TEXTS)
