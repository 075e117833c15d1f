"""Personal data: candidate spans from generators, boosted trees on their format and context, thresholds.

Base kinds (email, ip, card, phone) are exact patterns with checks and always stay. Beside them,
generators propose spans of further kinds, with high recall and overlaps: tokens that hold digits or only
capitals, and groups of digits with blanks between. Boosted regression trees score a candidate from its form and what
stands around it; a candidate is taken if its score passes the threshold of its kind, overlaps no base
span, and no better candidate overlaps it.

There are no labels for such spans. The trees learn from weak labels: forms that are known to be credentials
or personal numbers, against all other candidates. Their sample is bounded for each kind and label, so a rare
form is in it however large the corpus is; each kind and label weighs the same. The thresholds are the lowest ones
whose precision reaches ``PRECISION`` on the candidates of all documents that the trees have not seen, by
histograms of scores that tasks count.

Each text is scanned whole in narrow passes; only counts and the sample are shuffled, only the trees are sent to the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
"""Distinct candidates of each kind and weak label, those of smallest hash, that train the trees."""

PRECISION = 0.9
SCORE_BINS = 1024
TREES, DEPTH, RATE, BINS = 30, 3, 0.3, 32

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")

# The forms of the base kinds and of candidates, and words that announce private data.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # runs of digits are taken whole: a match never starts or ends inside one
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_TOKEN = re.compile(r"[0-9]\S*")
CAPITALS = re.compile(r"[A-Z]{16,}")
DIGIT_GROUP = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
EDGES = "\"'`.,;:!?()[]{}<>"
KNOWN_SECRET = re.compile(r"AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|(?i:pass(?:word|wd)?|pwd|secret|token|api_?key)[=:]\S{6,}|[0-9a-f]{32,}|[0-9a-f-]{36}")
KNOWN_NUMBER = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
ANNOUNCES = ("pass", "pwd", "secret", "token", "key", "ssn", "phone", "tel", "call", "account", "card", "iban", "id:")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number holds."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; matches that fail their check are dropped."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := LOCAL.match(text, start)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


class Taken:
    """Places of a text that spans hold, as disjoint runs in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        """Whether no run has a place from ``start`` to ``end``."""
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start

    def add(self, start: int, end: int) -> None:
        """Take places that are free."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be private: tokens with a digit and letters or of capitals (secret), digits with or without separators (number)."""
    found = []
    for m in DIGIT_TOKEN.finditer(text):
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if end - start >= 8 and re.search("[A-Za-z]", text[start:end]):
            found.append(("secret", start, end))
    tokens = Taken(found)
    found += [("secret", *m.span()) for m in CAPITALS.finditer(text) if tokens.free(m.start(), m.start() + 1)]
    for m in DIGIT_GROUP.finditer(text):
        found.append(("number", *m.span()))
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form of the span and what stands around it."""
    span = text[start:end]
    n = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    upper = sum("A" <= c <= "Z" for c in span)
    hexed = sum(c in "0123456789abcdef" for c in span)
    runs = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(span, span[1:], strict=False))
    before = text[max(0, start - 16) : start].lower()
    inside = span.lower()
    announced = any(w in before or w in inside for w in ANNOUNCES)
    quoted = start > 0 and end < len(text) and text[start - 1] in "\"'" and text[end] in "\"'"
    return [
        kind == "secret",
        n,
        digits / n,
        upper / n,
        hexed / n,
        runs / n,
        len(set(span)) / n,
        announced,
        quoted,
        span.count("="),
        span.count("-"),
        span.count("."),
        span.count("("),
        sum(c in " " for c in span),
        sum(ord(c) > 127 for c in span) / n,
        before[-1:] in "=:",
    ]


def weak_label(text: str, kind: str, start: int, end: int) -> bool:
    """Whether the form of a candidate is a known one of its kind."""
    return bool((KNOWN_SECRET if kind == "secret" else KNOWN_NUMBER).fullmatch(text[start:end]))


@dataclass(frozen=True)
class Model:
    """Trees as ``(feature, cut, left, right)`` rows per tree with leaf values, and a threshold per kind."""

    bias: float
    trees: tuple
    thresholds: dict

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list]:
    """Boosted trees of logistic loss: cuts at quantiles of both labels, leaves by one Newton step."""
    bias = float(np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    total, trees = np.full(len(y), bias), []
    shares = np.linspace(0, 1, BINS + 1)[:-1]
    sides = [x[y == label] for label in (0, 1) if (y == label).any()]  # the cuts of a rare label are not those of the other
    cuts = [np.unique(np.concatenate([np.quantile(s[:, j], shares) for s in sides])) for j in range(x.shape[1])]
    inner, size = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = node == at
            best = 1e-6
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j in range(x.shape[1]):
                side = np.searchsorted(cuts[j], x[rows, j])
                gs, hs = (np.bincount(side, v[rows], len(cuts[j]) + 1).cumsum()[:-1] for v in (g, h))
                gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, cuts[j][k]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        for leaf in range(inner, size):
            rows = node == leaf
            value[leaf] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        total += value[node]
        trees.append((feature, cut, value))
    return bias, trees


def threshold(counts: np.ndarray) -> float:
    """The lowest score from which on ``PRECISION`` of the candidates have the label, 0.5 at least; 2.0, i.e. never, if there is none.

    ``counts`` holds the candidates by label (0, 1) and bin of their score.
    """
    at = np.flatnonzero(counts.sum(axis=0))[::-1]
    zeros, ones = counts[:, at].cumsum(axis=1)
    good = np.flatnonzero(ones >= PRECISION * (zeros + ones))
    if not len(good):
        return 2.0
    below = at[good[-1] + 1] + 1 if good[-1] + 1 < len(at) else 0
    return max(0.5, float(at[good[-1]] + below) / 2 / SCORE_BINS)  # halfway to the first bin left out


def spans_of(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    chosen: list[list] = [[] for _ in texts]
    taken = [Taken(b) for b in base]
    if proposed:
        scores = model.scores(np.array([features(texts[i], *c) for i, *c in proposed], float))
        for score, (i, kind, start, end) in sorted(zip(scores, proposed, strict=True), key=lambda p: (-p[0], p[1])):
            if score >= model.thresholds[kind] and taken[i].free(start, end):
                taken[i].add(start, end)
                chosen[i].append((kind, start, end))
    return [b + sorted(c, key=lambda s: (KINDS.index(s[0]), s[1])) for b, c in zip(base, chosen, strict=True)]


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch with candidates: ``(text, kind, start, end)``, weak labels, hashes by text and place, whether the text is held out."""
    for batch in batches:
        found, keys, held = [], [], []
        for text in batch.column(0).to_pylist():
            own = candidates(text)
            if own:
                of_text = xxhash.xxh64_intdigest(text.encode())
                found += [(text, *c) for c in own]
                keys += [xxhash.xxh64_intdigest(b"%d %d" % (a, b), of_text) >> 11 for _, a, b in own]
                held += [of_text % 4 == 3] * len(own)
        if found:
            yield found, np.array([weak_label(*f) for f in found]), np.array(keys, np.int64), np.array(held)


def fit(docs: DataFrame) -> Model:
    """The model from the candidates of all documents; without any weak label, one that takes no candidate.

    Copies of a text count once for the trees. A quarter of the texts, by hash, is held out for the thresholds; of
    a kind whose labels are all on one side, both sides serve for both.
    """
    texts = docs.select("text").filter(F.col("text").rlike("[0-9]|[A-Z]{16}"))  # every candidate has one of these
    never = {k: 2.0 for k in KINDS}

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, labels, keys, held in _found(batches):
            columns = [pa.array([f[1] for f in found]), pa.array(labels), pa.array(held), pa.array(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "label", "held", "key"])

    marked = texts.mapInArrow(marks, "kind string, label boolean, held boolean, key long")
    counted = marked.groupBy("kind", "label", "held").agg(F.approx_count_distinct("key").alias("n")).collect()
    n = {(r.kind, r.label, r.held): r.n for r in counted}
    kinds = [k for k in KINDS if (k, True, True) in n or (k, True, False) in n]
    if not kinds:
        return Model(0.0, (), never)
    whole = {k for k in KINDS if k not in kinds or (k, True, True) not in n or (k, True, False) not in n}
    limits = {}
    for kind, label, _ in n:
        size = n.get((kind, label, False), 0) + (n.get((kind, label, True), 0) if kind in whole else 0)
        limits[kind, label] = int((1 << 53) * min(1.0, (2 * SAMPLE + 1000) / max(size, 1)))

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, labels, keys, held in _found(batches):
            chosen = [i for i, f in enumerate(found) if keys[i] < limits[f[1], bool(labels[i])] and (f[1] in whole or not held[i])]
            x = pa.array([features(*found[i]) for i in chosen], pa.list_(pa.float64()))
            columns = [pa.array([found[i][1] for i in chosen], pa.string()), pa.array(labels[chosen]), pa.array(keys[chosen]), x]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "label", "key", "x"])

    sampled = texts.mapInArrow(sample, "kind string, label boolean, key long, x array<double>")
    strata: dict[tuple, list] = {}
    for r in sorted(sampled.dropDuplicates(["kind", "label", "key"]).collect()):  # some thousands of each kind and label
        strata.setdefault((r.kind, r.label), []).append(r.x)
    strata = {k: v[:SAMPLE] for k, v in strata.items()}
    x = np.array([row for rows in strata.values() for row in rows], float)
    y = np.concatenate([np.full(len(rows), float(label)) for (_, label), rows in strata.items()])
    weight = np.concatenate([np.full(len(rows), len(x) / len(strata) / len(rows)) for rows in strata.values()])
    bias, trees = boost(x, y, weight)
    model = Model(bias, tuple(trees), never)

    def histograms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(KINDS), 2, SCORE_BINS), np.int64)
        for found, labels, _, held in _found(batches):
            use = [i for i, f in enumerate(found) if held[i] or f[1] in whole]
            if use:
                scores = model.scores(np.array([features(*found[i]) for i in use], float))
                at = np.minimum((scores * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
                np.add.at(counts, ([KINDS.index(found[i][1]) for i in use], labels[use].astype(np.int64), at), 1)
        where = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*map(pa.array, where), pa.array(counts[where])], ["kind", "label", "bin", "n"])

    counts = np.zeros((len(KINDS), 2, SCORE_BINS), np.int64)
    for r in texts.mapInArrow(histograms, "kind long, label long, bin long, n long").groupBy("kind", "label", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r.kind, r.label, r.bin] = r.n
    return Model(bias, tuple(trees), never | {k: threshold(counts[KINDS.index(k)]) for k in kinds})


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, spans)`` of every row; ``spans`` holds ``(kind, start, end)`` in code points, end exclusive.

    NULL and empty texts have no spans. Very long texts, runs of digits and numbers of spans take time in proportion
    to their length. Repeated rows and NULL ids are kept; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = spans_of([t or "" for t in batch.column(1).to_pylist()], model)
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not text or not spans:
        return text
    out, done, last = [], 0, -1
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start < last:
            last = max(last, end)
        else:
            if last >= 0:
                done = last
            out.append(text[max(done, 0) : start] + f"[{kind.upper()}]")
            last = end
    return "".join(out) + text[last:]


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced; other columns and all rows as they are."""

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        import pandas as pd

        texts = [t or "" for t in column]
        found = spans_of(texts, model)
        return pd.Series([None if t is None else redact(t, s) for t, s in zip(column, found, strict=True)], dtype=object)

    return docs.withColumn("text", run(F.col("text")))
