"""Byte-level BPE by recursive queries: each partition encodes its distinct words in an embedded database.

Spark deals the texts; a task splits them with the tokenizer's pattern and keeps the distinct matches. A
recursive query holds one row per word and token position: rows join the merge table on the pair of
neighbours, and a round contracts every pair that no other merge can forestall. Words that are left with pairs
that another merge could forestall go on in a second recursive query, which contracts the leftmost pair of
minimum rank of each word in a round. The ids of each word, in order, are joined as text, and the bytes that
the vocabulary has for them give the bytes back. A text is the concatenation of its words.

Why contracting many pairs at once is exact: let ``ab`` have rank r, with ``p`` before and ``c`` after it, all of them
tokens that the one-by-one order makes too. It contracts ``ab`` unless it contracts ``b`` with a token that begins with
``c``, or ``a`` with one that ends in ``p``, at a rank below r. A token is made in one way only, by the
merges of its bytes alone, so the token beside must have ``c`` among the first parts, or ``p`` among the last parts, of
which it is made; the least rank of such merges is kept for each pair of neighbours. This needs merges whose rank is above
those of their parts, as training gives them; with other ranks every word goes to the second query. (The second goes on
from where the first ends: contracting a pair early makes only pairs of higher rank, so none comes before its time.)

A word of more than ``LONG`` bytes is encoded in blocks, which is exact: no merge ever crosses a border of two
blocks if the last token of the one and the first of the other, joined and encoded by themselves, stay apart.
(Merges inside both tokens come in the same order there as in the whole word, so the first merge across the
border would come there too.) Borders are taken from windows encoded beforehand; blocks on both sides of a border
that fails are joined and encoded again. Blocks that stay long that way are periodic: they have few distinct
pairs, and a round contracts all of the least one.

Memory: the words of ``CHUNK`` bytes at a time are in the database, and up to ``KNOWN_WORDS`` words in a worker
process, which keeps them from task to task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from blockquery.llm.common import batches_of

CHUNK = 1 << 20
"""Bytes of distinct words that one recursive query encodes."""

KNOWN_WORDS = 1 << 19
"""Words that a worker process remembers before it starts anew."""

LONG, BLOCK, WINDOW = 512, 128, 64
"""Bytes of a word that is cut, of a block, and on either side of the place where a border is looked for."""

NEVER = (1 << 31) - 1
"""Above every rank."""

# One round: a row goes with the one after it if the merge of both comes before any merge of the first with what is before it (``ends``
# there) and not after any merge of the second with what is after it (``begins`` there); equal ranks go from the left. Names with
# digits are of the rows around: m_1 is ``merged`` one row back, m1 one row on. The last row of a word has no row after it, so words stay apart.
TOGETHER = f"""
WITH RECURSIVE step AS (
  SELECT w, pos, tok, following, false AS done, false AS more FROM start
  UNION ALL
  (
    WITH pairs AS (
      SELECT s.w, s.pos, s.tok, s.following, b.merged, coalesce(b.ends, {NEVER}) AS ends, coalesce(b.begins, {NEVER}) AS begins
      FROM step s LEFT JOIN borders b ON b.a = s.tok AND b.b = s.following
      WHERE NOT done
    ), around AS (
      SELECT *, lag(merged) OVER o AS m_1, lead(merged) OVER o AS m1, lead(merged, 2) OVER o AS m2, lead(following) OVER o AS f1,
        lag(ends, 1, {NEVER}) OVER o AS e_1, lag(ends, 2, {NEVER}) OVER o AS e_2, lead(ends, 1, {NEVER}) OVER o AS e1,
        lead(begins, 1, {NEVER}) OVER o AS b1, lead(begins, 2, {NEVER}) OVER o AS b2, lead(begins, 3, {NEVER}) OVER o AS b3
      FROM pairs WINDOW o AS (ORDER BY pos)
    ), marked AS MATERIALIZED (
      SELECT w, pos, tok, merged, coalesce(merged < e_1 AND merged <= b1, false) AS goes, coalesce(m_1 < e_2 AND m_1 <= begins, false) AS gone,
        CASE WHEN following IS NULL OR goes AND f1 IS NULL THEN NULL
          WHEN goes THEN CASE WHEN m2 < e1 AND m2 <= b3 THEN m2 ELSE f1 END
          WHEN m1 < ends AND m1 <= b2 THEN m1 ELSE following END AS next
      FROM around
    )
    SELECT w, pos, CASE WHEN goes THEN merged ELSE tok END, next, false, false
    FROM marked SEMI JOIN (SELECT w FROM marked WHERE goes) USING (w)
    WHERE NOT gone
    UNION ALL
    SELECT w, pos, tok, NULL, true, merged IS NOT NULL
    FROM marked ANTI JOIN (SELECT w FROM marked WHERE goes) USING (w)
  )
)
SELECT w, pos, tok, more FROM step WHERE done
"""
# One round: ``pair`` is rank and position of the merge that starts at a row, ``best`` the least of its word.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0 AS round FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN pair = best THEN CAST(pair >> 32 AS INTEGER) ELSE tok END, round + 1
  FROM (
    SELECT w, pos, tok, round, pair, lag(pair) OVER (PARTITION BY w ORDER BY pos) AS before, min(pair) OVER (PARTITION BY w) AS best
    FROM (
      SELECT s.w, s.pos, s.tok, s.round, (CAST(m.merged AS BIGINT) << 32) + s.pos AS pair
      FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS following FROM step) s
      LEFT JOIN merges m ON m.a = s.tok AND m.b = s.following
    )
  )
  WHERE best IS NOT NULL AND before IS DISTINCT FROM best
)
SELECT w, pos, tok FROM step SEMI JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round)
"""
# The same for long periodic words: where no token made of the result of a merge has a lower rank, all pairs of the
# least rank go at once, from the left; in a run of overlapping ones every other.
ENCODE_RUNS = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0 AS round FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN goes THEN merged ELSE tok END, round + 1
  FROM (
    SELECT w, pos, tok, round, merged, goes, lag(goes, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(least_one, false) AND (n = 1 OR alone = 0 AND row_number() OVER (PARTITION BY w, run, least_one ORDER BY pos) % 2 = 1) AS goes
      FROM (
        SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) - row_number() OVER (PARTITION BY w, least_one ORDER BY pos) AS run,
          row_number() OVER (PARTITION BY w, least_one ORDER BY pos) AS n
        FROM (
          SELECT *, merged = min(merged) OVER (PARTITION BY w) AS least_one, min(merged) OVER (PARTITION BY w) AS best
          FROM (
            SELECT s.w, s.pos, s.tok, s.round, m.merged, m.alone
            FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS following FROM step) s
            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.following
          )
        )
        WHERE best IS NOT NULL
      )
    )
  )
  WHERE NOT gone
)
SELECT w, pos, tok FROM step SEMI JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def parts_of(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """The two tokens that the last merge of a token joins, of each token that merges can make."""
    out = {}
    for token in ranks:
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        if len(cuts) == 1:
            out[token] = cuts[0]
        elif cuts:  # one of them at most comes about
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2 and (near := [(ranks[x + y], i) for i, (x, y) in enumerate(pairwise(parts)) if x + y in ranks]):
                i = min(near)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                out[token] = parts[0], parts[1]
    return out


def _borders(ranks: dict[bytes, int], parts: dict[bytes, tuple[bytes, bytes]]) -> pa.Table:
    """Of each pair of neighbours ``(a, b)`` that a merge can have on both sides of its middle: ``merged``, the token that joins them; ``begins``, the
    least rank of a merge of ``a`` with a token that ``b`` grows into; ``ends``, that of a merge of a token that ``a`` grows into with ``b``."""

    def grown_from(token: bytes, side: int) -> Iterator[int]:
        yield ranks[token]
        while token in parts:
            token = parts[token][side]
            yield ranks[token]

    merged: dict[tuple[int, int], int] = {}
    begins: dict[tuple[int, int], int] = {}
    ends: dict[tuple[int, int], int] = {}
    for token, (x, y) in sorted(parts.items(), key=lambda t: -ranks[t[0]]):  # the least rank is written last
        a, b, rank = ranks[x], ranks[y], ranks[token]
        merged[a, b] = rank
        begins |= {(a, i): rank for i in grown_from(y, 0)}
        ends |= {(i, b): rank for i in grown_from(x, 1)}
    keys = list(begins.keys() | ends.keys())
    columns = [[k[0] for k in keys], [k[1] for k in keys], *([d.get(k) for k in keys] for d in (merged, begins, ends))]
    return pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("a", "b", "merged", "begins", "ends"), columns, strict=True)})


@dataclass
class Vocabulary:
    """An in-memory database with the tables of merges and borders, and what else a rank file gives."""

    con: duckdb.DuckDBPyConnection
    ranks: dict[bytes, int]
    tokens: dict[int, bytes]
    single: np.ndarray
    names: pa.Array
    """Decimal text by rank."""
    bytes_of: pa.Array
    """Bytes by rank."""
    ordered: bool
    """Every merge has a rank above those of its parts' merges."""


@cache
def _vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file.

    ``merges`` holds the last merge of each token: merges within its bytes come as in the token by itself, so no other merge makes it.
    ``alone`` is 1 where a token that a pair makes is part of a merge of lower rank, so that one contraction may bring forth another before its equals.
    """
    ranks = read_ranks(path)
    parts = parts_of(ranks)
    pairs = [(ranks[x], ranks[y], ranks[t]) for t, (x, y) in parts.items()]
    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
    a, b, merged = (pa.array(x, pa.int32()) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
    sooner = {t for x, y, r in pairs for t in (x, y) if r < t}
    con.register("pairs_in", pa.table({"a": a, "b": b, "merged": merged, "alone": pa.array([int(r in sooner) for _, _, r in pairs], pa.int32())}))
    con.execute("CREATE TABLE merges AS SELECT * FROM pairs_in")
    con.register("borders_in", _borders(ranks, parts))
    con.execute("CREATE TABLE borders AS SELECT * FROM borders_in")
    tokens = {r: t for t, r in ranks.items()}
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    ordered = all(ranks[t] > ranks[x] for t, both in parts.items() for x in both if x in parts)
    every = range(max(tokens) + 1)
    return Vocabulary(con, ranks, tokens, single, pa.array(map(str, every), pa.string()), pa.array([tokens.get(i) for i in every], pa.binary()), ordered)


def _chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    first = 0
    while first < len(words):
        last, size = first, 0
        while last < len(words) and (last == first or size + len(words[last]) <= CHUNK):
            size += len(words[last])
            last += 1
        yield words[first:last]
        first = last


def _rows(columns: pa.Table | dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(columns[n]) for n in ("w", "pos", "tok"))


def _coded(path: str, part: list[bytes], whole: bool, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of a chunk one after another, and the number of ids of each; with ``whole``, a word that is a token is that token."""
    own = _vocabulary(path)
    lengths = np.fromiter(map(len, part), np.int64, len(part))
    tok = own.single[np.frombuffer(b"".join(part), np.uint8)]
    if tokens := [i for i, w in enumerate(part) if w in own.ranks] if whole else []:
        first = np.cumsum(lengths) - lengths
        tok[first[tokens]] = [own.ranks[part[i]] for i in tokens]
        keep = np.ones(len(tok), bool)
        for i in tokens:
            keep[first[i] + 1 : first[i] + lengths[i]] = False
        lengths[tokens], tok = 1, tok[keep]
    w = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
    left = {"w": w, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}
    found = []
    if own.ordered and not runs:
        last = np.diff(w, append=-1) != 0
        own.con.register("start", pa.table(left | {"following": pa.array(np.append(tok[1:], np.int32(0))[: len(tok)], mask=last)}))
        table = own.con.sql(TOGETHER).to_arrow_table()
        rows = _rows(table)
        again = np.zeros(len(part), bool)
        again[rows[0][np.asarray(table["more"])]] = True
        more = again[rows[0]]
        found.append(tuple(c[~more] for c in rows))
        left = {n: c[more] for n, c in zip(left, rows, strict=True)}
    own.con.register("start", pa.table(left))
    found.append(_rows(own.con.sql(ENCODE_RUNS if runs else ENCODE).to_arrow_table()))
    w, pos, tok = (np.concatenate(c) for c in zip(*found, strict=True))
    return tok[np.argsort(pos)], np.bincount(w, minlength=len(part))


def _merged_ids(path: str, words: list[bytes]) -> dict[bytes, list[int]]:
    """Ids of byte strings by merges alone."""
    out = {}
    for long in (False, True):
        for part in _chunks([w for w in dict.fromkeys(words) if (len(w) > 1024) is long]):
            tok, n = _coded(path, part, False, runs=long)
            ends = [0, *np.cumsum(n).tolist()]
            flat = tok.tolist()
            out |= {w: flat[a:b] for w, a, b in zip(part, ends, ends[1:], strict=False)}
    return out


def long_word_ids(path: str, word: bytes) -> list[int]:
    """Ids of a long word by blocks whose borders no merge crosses."""
    tokens = _vocabulary(path).tokens
    middles = range(BLOCK, len(word) - WINDOW, BLOCK)
    windows = [word[m - WINDOW : m + WINDOW] for m in middles]
    coded = _merged_ids(path, windows)
    cuts = [0]
    for m, window in zip(middles, windows, strict=True):
        ends = np.cumsum([len(tokens[i]) for i in coded[window]])
        cuts.append(m - WINDOW + int(ends[np.abs(ends - WINDOW).argmin()]))
    cuts = [*sorted({c for c in cuts if c < len(word)}), len(word)]
    known: dict[bytes, list[int]] = {}
    apart: dict[tuple[int, int], bool] = {}
    while True:
        blocks = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        known |= _merged_ids(path, [b for b in blocks if b not in known])
        borders = [(known[x][-1], known[y][0]) for x, y in zip(blocks, blocks[1:], strict=False)]
        fresh = [b for b in dict.fromkeys(borders) if b not in apart]
        joined = _merged_ids(path, [tokens[a] + tokens[b] for a, b in fresh])
        apart |= {(a, b): joined[tokens[a] + tokens[b]] == [a, b] for a, b in fresh}
        if all(apart[b] for b in borders):
            return [i for b in blocks for i in known[b]]
        cuts = [0, *(c for c, b in zip(cuts[1:-1], borders, strict=True) if apart[b]), len(word)]


def _joined(values: pa.Array, places: np.ndarray, ends: np.ndarray, separator: str | bytes) -> pa.Array:
    """The values at some places, joined from each end to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(places))), separator)


def _encoded(path: str, words: list[bytes]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Ids as text, number of ids and decoded bytes of the words, a chunk at a time."""
    own = _vocabulary(path)
    long = {w: np.array(long_word_ids(path, w), np.int32) for w in words if len(w) > LONG and w not in own.ranks}
    for part in _chunks(words):
        tok, n = _coded(path, [w for w in part if w not in long] if long else part, True)
        if len(n) < len(part):
            short = iter(np.split(tok, np.cumsum(n)))
            each = [long[w] if w in long else next(short) for w in part]
            tok, n = np.concatenate(each), np.array([len(e) for e in each])
        ends = np.append(0, np.cumsum(n))
        yield _joined(own.names, tok, ends, " "), n, _joined(own.bytes_of, tok, ends, b"")


def encode_words(path: str, words: list[bytes]) -> tuple[list[str], list[int], list[bytes]]:
    """Ids as text, number of ids and decoded bytes of each word."""
    ids, n, back = ([x for c in columns for x in c.tolist()] for columns in zip(*_encoded(path, words), strict=True)) if words else ([], [], [])
    return ids, n, back


class Known:
    """Places of the words that this worker process has encoded, and their ids as text, numbers of ids and bytes."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.counts, self.back = pa.array([], pa.string()), np.empty(0, np.int64), pa.array([], pa.binary())

    def add(self, words: list[str]) -> None:
        ids, counts, back = ([*c] for c in zip(*_encoded(self.path, [w.encode() for w in words]), strict=True)) if words else ([], [], [])
        self.ids, self.back = pa.concat_arrays([self.ids, *ids]), pa.concat_arrays([self.back, *back])
        self.counts = np.concatenate([self.counts, *counts])
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))


@cache
def _known(path: str) -> Known:
    return Known(path)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded)`` of every row: ids as decimal text joined by spaces, decoded bytes.

    NULL and empty texts have no ids and empty bytes. Each match of ``pattern`` is encoded separately; a match
    that is a token itself is that token. Characters that no match covers are left out, as in a tokenizer. Very long
    texts and matches take time in proportion to their length. An empty table gives no rows.
    Repeated rows and NULL ids are encoded like others; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        known = _known(path)
        for batch in batches_of(batches, 4 << 20, "text"):
            if len(known.places) > KNOWN_WORDS:
                known.clear()
            words_of = [split(t or "") for t in batch.column(1).to_pylist()]
            known.add(list(set().union(*words_of).difference(known.places)))
            ends = np.cumsum([0, *map(len, words_of)])
            places = np.fromiter(map(known.places.__getitem__, chain.from_iterable(words_of)), np.int64, ends[-1])
            n = np.append(0, np.cumsum(known.counts[places]))[ends]
            out = [batch.column(0), _joined(known.ids, places, ends, " "), pa.array(np.diff(n)), _joined(known.back, places, ends, b"")]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids string, n_tokens long, decoded binary")
