"""Hashed maximum-entropy language model with a class-factored softmax.

The probability of a word is that of its class, given what stands before it, times that of the word in its
class, given the same. Each of the most frequent words is a class of its own; other words are classed by a hash of
their last two bytes, so unseen words have a class too. The class is predicted by a log-linear model whose
features (the word before, the two before together, and each of the two before those, skipped to) are hashed
into a table of fixed size.

Inside a class the softmax is over a binary tree of the frequent words and one leaf for all others. A
decision is a softmax over two sides: the log odds of their counts plus a weight for each of the two words
before, hashed together with the decision into a second table (with pairs, held-out texts scored worse). The decisions of all leaves sum to one, and with weights of
zero a leaf has its plain share. Below the leaf of the other words, a word has its share of their counts.

Training: tasks take the tables, make gradient steps over the documents of their partition in sparse numpy
batches, and return by how much each row changed, weighted by how often it was used; changes are added up by
block in a shuffle. ``ROUNDS`` rounds take a different part of the training documents each, all together once.

Word counts cover all training documents. The most frequent words, at most ``HEAD``, are sent to the tasks;
counts of all others are joined by hash of the word, after the words of a document have been counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import Steps, batches_of, texts_of

HEAD = 400_000
"""Words whose counts are sent to the tasks, at most."""

TOP, SUFFIXES = 16, 16
CLASSES = TOP + SUFFIXES
ROWS = 1 << 15
"""Rows of the feature table."""

ROUNDS, RATE, MINI = 3, 0.08, 1 << 14
BLOCK = 1 << 9
"""Rows of the table that are added up together."""

FLOOR = 0.02
"""Share of the plain frequencies in a prediction."""

SLOTS, SPAN = 1 << 20, 1 << 14
"""Weights of the decisions inside classes, and how many of them are added up together."""

PREFIX = 18
"""Bits of a hash by which a frequent word is looked up."""

STRIDE = 1 << 17
"""Tokens whose decisions make one gradient step."""

BATCH = 2 << 20
U = np.uint64
_RANDOM = np.random.default_rng(6)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
FACTOR = 0x9E3779B97F4A7C15
POWERS = {}
END = U(0x5851F42D4C957F2D)
"""Hash that stands for the end of a text."""

SALTS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def _powers(n: int, factor: int) -> np.ndarray:
    """``factor ** i`` modulo 2**64 for ``i`` below ``n``."""
    if len(POWERS.get(factor, ())) < n:
        steps = np.full(max(n, BATCH), factor, np.uint64)
        steps[0] = 1
        POWERS[factor] = np.multiply.accumulate(steps)
    return POWERS[factor][:n]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, suffix class and text number of all tokens; each text ends with an end token."""
    lengths = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lower = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[lower] * _powers(len(data), FACTOR), out=sums[1:])
    inverse = _powers(len(data), pow(FACTOR, -1, 1 << 64))
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    last = lower[ends - 1].astype(np.uint64) * U(256) + np.where(ends - starts > 1, lower[ends - 2], 0).astype(np.uint64)
    suffix = TOP + (_mix(last * U(FACTOR)) % U(SUFFIXES)).astype(np.int64)
    borders = np.cumsum(lengths)
    of = np.searchsorted(borders, starts, side="right")
    of = np.append(of, np.arange(len(texts)))
    order = np.argsort(of, kind="stable")
    ends_of_texts = np.full(len(texts), END)
    return np.append(hashes, ends_of_texts)[order], np.append(suffix, np.full(len(texts), TOP))[order], of[order]


def contexts(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Hashes of the four features of each token; before a text stands nothing."""

    def back(n: int) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        same = of[n:] == of[:-n] if len(h) > n else np.empty(0, bool)
        out[n:][same] = h[:-n][same] if len(h) > n else 0
        return out

    one, two, three = back(1), back(2), back(3)
    mixed = (one * SALTS[0], _mix(one * SALTS[1]) + two, two * SALTS[2], three * SALTS[3])
    return np.stack([_mix(m * U(FACTOR)) for m in mixed], axis=1)


def table_rows(features: np.ndarray) -> np.ndarray:
    """Rows of the feature table. The narrow type sorts faster."""
    return (features % U(ROWS)).astype(np.uint16)


@dataclass(frozen=True)
class Head:
    """Hashes (sorted), counts and classes of the frequent words; totals of all words and by class."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @cached_property
    def starts(self) -> np.ndarray:
        """The first word that may have each value of the first ``PREFIX`` bits of a hash."""
        first = np.arange(1 << PREFIX, dtype=np.uint64) << U(64 - PREFIX)
        return np.minimum(np.searchsorted(self.hashes, first), len(self.hashes) - 1).astype(np.int32)

    def class_weight(self) -> np.ndarray:
        """Smoothed counts of each class, with an unseen word."""
        return self.class_total + 0.1 * (self.class_distinct + 1)

    def find(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count (0 if not among the frequent words), class and place among the frequent words (-1) of each token."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), suffix, np.full(len(h), -1)
        at = np.take(self.starts, (h >> U(64 - PREFIX)).astype(np.int64))
        last = len(self.hashes) - 1
        todo = np.flatnonzero((at < last) & (self.hashes[at] < h))
        while len(todo):  # some steps: hashes are spread evenly over the prefixes
            at[todo] += 1
            now = at[todo]
            todo = todo[(now < last) & (self.hashes[now] < h[todo])]
        hit = self.hashes[at] == h
        return np.where(hit, self.counts[at], 0), np.where(hit, self.classes[at], suffix), np.where(hit, at, -1)


@dataclass(frozen=True)
class Trees:
    """A binary tree of the frequent words of each class and a leaf for its other words.

    Leaves are numbered class by class, from heavy to light. A decision is named by the first leaf of its right
    side; ``left`` and ``right`` are the decisions that follow (0: a leaf), ``odds`` the log odds of the right side.
    """

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    odds: np.ndarray
    leaves: np.ndarray
    rest: np.ndarray
    rest_weight: np.ndarray

    def paths(self, place: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, decision and side (1: right) of all decisions on the way from the root to the leaf of each token."""
        at = self.rest[classes]
        known = place >= 0
        at[known] = self.leaves[place[known]]
        decision = self.roots[classes]
        token = np.flatnonzero(decision)
        at, decision = at[token], decision[token]
        levels = [(token, decision, at >= decision)]
        while len(token):
            side = levels[-1][2]
            following = np.where(side, self.right[decision], self.left[decision])
            on = np.flatnonzero(following)
            token, at, decision = token[on], at[on], following[on]
            levels.append((token, decision, at >= decision))
        return tuple(map(np.concatenate, zip(*levels, strict=True)))


def trees(words: Head) -> Trees:
    """Trees whose decisions part the smoothed counts as evenly as the order of the leaves lets them."""
    in_head = np.bincount(words.classes, words.counts, CLASSES).astype(np.int64), np.bincount(words.classes, minlength=CLASSES)
    rest_weight = words.class_total - in_head[0] + 0.1 * (words.class_distinct - in_head[1] + 1)
    weights = np.append(words.counts + 0.1, rest_weight[TOP:])  # a word that is a class of its own has no others beside it
    classes = np.append(words.classes, np.arange(TOP, CLASSES))
    order = np.lexsort((-weights, classes))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    sums = np.append(0, np.cumsum(weights[order]))
    borders = np.searchsorted(classes[order], np.arange(CLASSES + 1)).astype(np.int32)
    roots = np.zeros(CLASSES, np.int32)
    left, right, odds = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32), np.zeros(len(order), np.float32)
    of = np.flatnonzero(np.diff(borders) > 1)
    first, last = borders[of], borders[of + 1]
    into, above = [roots], [of]
    while len(first):
        half = (sums[first] + sums[last]) / 2
        cut = np.searchsorted(sums, half)
        cut -= half - sums[cut - 1] < sums[cut] - half
        cut = np.clip(cut, first + 1, last - 1).astype(np.int32)
        odds[cut] = np.log(sums[last] - sums[cut]) - np.log(sums[cut] - sums[first])
        start = 0
        for target, where in zip(into, above, strict=True):
            target[where] = cut[start : start + len(where)]
            start += len(where)
        lower, upper = cut - first > 1, last - cut > 1
        into, above = [left, right], [cut[lower], cut[upper]]
        first, last = np.append(first[lower], cut[upper]), np.append(cut[lower], last[upper])
    rest = np.zeros(CLASSES, np.int32)
    rest[TOP:] = place[len(words.counts) :]
    return Trees(roots, left, right, odds, place[: len(words.counts)], rest, rest_weight)


def _slots(features: np.ndarray, token: np.ndarray, decision: np.ndarray) -> list[np.ndarray]:
    """Places in the table of weights of decisions of tokens, by the word before and by the one before that."""
    own = decision.astype(np.uint32) * np.uint32(0x9E3779B1)
    shift = np.uint32(33 - SLOTS.bit_length())
    return [((np.take((features[:, f] >> U(32)).astype(np.uint32), token) ^ own) * np.uint32(0x85EBCA6B) >> shift).astype(np.int64) for f in (0, 2)]


def _log_odds(inside: Trees, weights: np.ndarray, slots: list[np.ndarray], decision: np.ndarray) -> np.ndarray:
    z = np.take(inside.odds, decision)
    for at in slots:
        z += np.take(weights, at, mode="clip")
    return z


def _exp(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The softmax of each row before it is divided by its sum."""
    z = np.take(table, rows[:, 0], axis=0)
    for f in range(1, rows.shape[1]):
        z += np.take(table, rows[:, f], axis=0)
    if max(z.max(initial=0), -z.min(initial=0)) > 80:  # exp would leave the range of the type
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _exp(table, rows)
    z /= (z @ np.ones(CLASSES, np.float32))[:, None]
    return z


def word_counts(train: DataFrame) -> DataFrame:
    """``(h, suffix, c)`` of all tokens; tasks add up what they have before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []
        size = 0
        for batch in batches_of(batches, BATCH, "text"):
            h, suffix, _ = tokens(texts_of(batch.column(0)))
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            seen.append((h, suffix[first], c))
            size += len(h)
            if size > 2_000_000:
                yield _added(seen)
                seen, size = [], 0
        if seen:
            yield _added(seen)

    parts = train.select("text").mapInArrow(run, "h long, suffix int, c long")
    return parts.groupBy("h").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c"))


def _added(seen: list[tuple]) -> pa.RecordBatch:
    h, suffix, c = (np.concatenate(x) for x in zip(*seen, strict=True))
    h, first, of = np.unique(h, return_index=True, return_inverse=True)
    c = np.bincount(of, c, len(h)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(suffix[first].astype(np.int32)), pa.array(c)], ["h", "suffix", "c"])


def head(counts: DataFrame) -> tuple[Head, int]:
    """The frequent words, and the count from which on words belong to them."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()
    least, words = 1 << 62, 0
    for b in bins:  # some hundreds at most: eighths of powers of two
        if words + b.n > HEAD:
            break
        least, words = b.least, words + b.n
    top = counts.filter(F.col("c") >= least).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    c, classes = top.column("c").to_numpy(), top.column("suffix").to_numpy().astype(np.int64)
    first = np.lexsort((h, -c))[:TOP]
    by_class = {r.suffix: r for r in counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    total = np.array([by_class[k].c if k in by_class else 0 for k in range(CLASSES)])
    distinct = np.array([by_class[k].n if k in by_class else 0 for k in range(CLASSES)])
    for k, i in enumerate(first):  # a frequent word leaves the class of its suffix
        total[classes[i]] -= c[i]
        distinct[classes[i]] -= 1
        total[k], distinct[k] = c[i], 1
        classes[i] = k
    order = np.argsort(h)
    return Head(h[order], c[order], classes[order], int(total.sum()), int(distinct.sum()), total, distinct), least


def train_tables(train: DataFrame, words: Head, inside: Trees, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """The feature table and the weights inside classes after ``ROUNDS`` rounds. ``train`` has ``part`` (the round of a row) and ``text``."""
    prior = (words.class_total + 1) / (words.class_total.sum() + CLASSES)
    table = np.tile((np.log(prior) / 4).astype(np.float32), (ROWS, 1))
    weights = np.zeros(SLOTS, np.float32)
    context = train.sparkSession.sparkContext
    known = context.broadcast((words, inside))
    for turn in range(ROUNDS):
        sent = context.broadcast((table, weights))
        rate = RATE / (1 + turn)

        def run(batches: Iterable[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            words, inside = known.value
            start, start_inside = sent.value
            mine, used = start.copy(), np.zeros(ROWS, np.float32)
            mine_inside, used_inside = start_inside.copy(), np.zeros(SLOTS, np.float32)
            for batch in batches_of(batches, BATCH, "text"):
                h, suffix, of = tokens(texts_of(batch.column(0)))
                _, classes, place = words.find(h, suffix)
                features = contexts(h, of)
                for a in range(0, len(h), STRIDE):
                    token, decision, side = inside.paths(place[a : a + STRIDE], classes[a : a + STRIDE])
                    slots = _slots(features[a : a + STRIDE], token, decision)
                    error = 1 / (1 + np.exp(-_log_odds(inside, mine_inside, slots, decision))) - side
                    n = sum(np.bincount(at, minlength=SLOTS) for at in slots).astype(np.float32)
                    total = sum(np.bincount(at, error, SLOTS) for at in slots).astype(np.float32)
                    mine_inside -= rate * total / np.sqrt(np.maximum(n, 1))
                    used_inside += n
                rows = table_rows(features)
                for a in range(0, len(h), MINI):
                    part = rows[a : a + MINI]
                    g = _softmax(mine, part)
                    g[np.arange(len(g)), classes[a : a + MINI]] -= 1
                    for f in range(part.shape[1]):
                        order = np.argsort(part[:, f], kind="stable")
                        sorted_rows = part[order, f]
                        first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
                        n = np.diff(np.append(first, len(order)))
                        at = sorted_rows[first]
                        step = np.take(g, order[first], axis=0)
                        several = np.flatnonzero(n > 1)
                        if len(several):  # most rows are used once and need no sum
                            members = np.take(g, order[np.repeat(n > 1, n)], axis=0)
                            step[several] = np.add.reduceat(members, np.cumsum(n[several]) - n[several], axis=0)
                        n = n.astype(np.float32)
                        step *= (rate / np.sqrt(n))[:, None]
                        mine[at] = np.take(mine, at, axis=0) - step
                        used[at] += n
            change = np.column_stack([(mine - start) * used[:, None], used])
            touched = [b for b in range(0, ROWS, BLOCK) if used[b : b + BLOCK].any()]
            data = [change[b : b + BLOCK].astype(np.float32).tobytes() for b in touched]
            change = np.stack([(mine_inside - start_inside) * used_inside, used_inside])
            touched_inside = [b for b in range(0, SLOTS, SPAN) if used_inside[b : b + SPAN].any()]
            data += [change[:, b : b + SPAN].tobytes() for b in touched_inside]
            touched += [ROWS + b for b in touched_inside]  # blocks from ROWS on are of the weights inside classes
            yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(data, pa.binary())], ["block", "change"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums[block] = sums.get(block, 0) + np.frombuffer(data, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["block", "change"])

        kinds = "block int, change binary"
        changes = train.filter(F.col("part") == turn).select("text").mapInArrow(run, kinds)
        table, weights = table.copy(), weights.copy()
        added = steps.keep(changes.repartition(ROWS // BLOCK, "block").mapInArrow(add, kinds))  # what tasks shuffled is removed
        for r in added.collect():  # the tables once
            if r.block >= ROWS:
                change, n = np.frombuffer(r.change, np.float32).reshape(2, SPAN)
                weights[r.block - ROWS : r.block - ROWS + SPAN] += change / np.maximum(n, 1)
                continue
            change = np.frombuffer(r.change, np.float32).reshape(BLOCK, CLASSES + 1)
            n = np.maximum(change[:, -1:], 1)
            table[r.block : r.block + BLOCK] += change[:, :-1] / n
        steps.drop(added)
        sent.unpersist()
    known.unpersist()
    return table, weights


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 10; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    NULL and empty texts have one token, the end. Repeated rows and NULL ids are scored like others; without
    any training row all counts are zero. Other columns are not read.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "language-model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("part")
    train = rows.filter(~held_out(F.col("doc_id"))).select("text", part)
    counts = steps.keep(word_counts(train))
    words, least = head(counts)
    inside = trees(words)
    context = spark.sparkContext
    model = context.broadcast((words, inside, *train_tables(train, words, inside, steps)))
    scale = np.log10(words.total + 0.1 * (words.distinct + 1))
    plain = ((words.class_total + 0.1) / (words.class_total.sum() + 0.1 * CLASSES)).astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, inside, table, weights = model.value
        class_weight, rest_weight = words.class_weight(), inside.rest_weight
        log_rest_weight = np.log10(rest_weight)
        row = TaskContext.get().partitionId() << 40
        for batch in batches_of(batches, BATCH, "text"):
            h, suffix, of = tokens(texts_of(batch.column(1)))
            count, classes, place = words.find(h, suffix)
            rest = count == 0
            features = contexts(h, of)
            rows_at = table_rows(features)
            own = np.empty(len(h))
            for a in range(0, len(h), MINI):
                p = _exp(table, rows_at[a : a + MINI])
                p = p[np.arange(len(p)), classes[a : a + MINI]] / (p @ np.ones(CLASSES, np.float32))
                p = p * (1 - FLOOR) + plain[classes[a : a + MINI]] * FLOOR
                own[a : a + MINI] = np.log10(p)
                of_class, r = classes[a : a + MINI], rest[a : a + MINI]
                token, decision, side = inside.paths(place[a : a + MINI], of_class)
                odds = _log_odds(inside, weights, _slots(features[a : a + MINI], token, decision), decision)
                path = np.bincount(token, np.log(1 + np.exp(np.minimum(np.where(side, -odds, odds), 80))), len(p))
                plain_share = np.where(r, rest_weight[of_class], count[a : a + MINI] + 0.1) / class_weight[of_class]
                log_p = np.log10(np.exp(-path) * (1 - FLOOR) + plain_share * FLOOR)
                # other words share their leaf by counts; a word that is a class of its own has all of its class
                own[a : a + MINI] += np.where(of_class < TOP, 0.0, log_p - np.where(r, log_rest_weight[of_class], 0.0))
            share = np.where(rest, 0.0, np.log10(count + 0.1))
            n = batch.num_rows
            log_base, log_own = np.bincount(of, share, n), np.bincount(of, own, n)
            known, total = np.bincount(of, ~rest, n).astype(np.int64), np.bincount(of, minlength=n)
            # words that are not among the frequent ones, counted by text
            order = np.lexsort((h[rest], of[rest]))
            rest_h, rest_of = h[rest][order], of[rest][order]
            first = np.flatnonzero(np.append(True, (rest_h[1:] != rest_h[:-1]) | (rest_of[1:] != rest_of[:-1]))) if len(order) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(order)))
            offsets = pa.array(np.searchsorted(rest_of[first], np.arange(n + 1)).astype(np.int32))
            entries = pa.StructArray.from_arrays([pa.array(rest_h[first].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"])
            columns = [batch.column(0), pa.array(row + np.arange(n)), *map(pa.array, (total, known, log_base, log_own)), pa.ListArray.from_arrays(offsets, entries)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_tokens", "known", "log_base", "log_own", "rest"])
            row += n

    kinds = "doc_id long, row long, n_tokens long, known long, log_base double, log_own double, rest array<struct<h: long, n: int>>"
    scored = steps.keep(rows.mapInArrow(run, kinds))
    rare = counts.filter(F.col("c") < least).select("h", "c")
    entries = scored.select("row", F.explode("rest").alias("e")).select("row", "e.h", "e.n")
    c = F.coalesce("c", F.lit(0))
    sums = entries.join(rare, "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("log_rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known_rest"))
    joined = scored.drop("rest").join(sums, "row", "left")
    log_rest = F.coalesce("log_rest", F.lit(0.0))
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("log_base") + log_rest - F.col("n_tokens") * float(scale)).alias("base_score"),
        (F.col("log_own") + log_rest).alias("score"),
    )
