"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled ones are learned from; unlabelled texts hold toxic ones too, in
the share that the class prior gives. The risk of a linear classifier under logistic loss is

    prior * R(positive as 1)  +  max(0, R(unlabelled as 0) - prior * R(positive as 0)),

and where the second part falls below zero, the step goes against it, so the fit cannot earn by calling
every unlabelled text clean.

Features are the presence of words and of their first letters, for the words that stand out in the
positives. Training runs in numpy on bounded samples (``POSITIVES`` and ``UNLABELLED`` texts of smallest
hash); the prior is counted over all labels. Scoring is one narrow pass over whole texts in numpy batches,
and only the bounded list of weights is sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import smallest_hashes, texts_of

POSITIVES, UNLABELLED = 2500, 6000
"""Texts to learn from, at most."""

FEATURES = 6000
"""Features of largest contrast, at most."""

PREFIXES = (4, 5, 6)
STEPS, RATE, SHRINK = 300, 0.05, 1e-3
EDGES = b".,;:!?\"'()[]{}"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(text: bytes) -> set[bytes]:
    """Words in lower case, without punctuation at their ends, and their first 4, 5 and 6 bytes marked ``*``."""
    words = {w.strip(EDGES) for w in text.lower().split()}
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in PREFIXES)) if words else words


def _mark(feature: bytes) -> int:
    return crc32(feature) & ((1 << 22) - 1)


@dataclass(frozen=True)
class Model:
    """Weight by feature, and the bias."""

    weights: dict
    bias: float

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        """Probability of being toxic; a text without known features gets the one of the bias."""
        get, known = self.weights.get, self.weights.keys()
        total = np.array([sum(map(get, sorted(features(t) & known))) for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(positives: list[bytes], unlabelled: list[bytes], prior: float) -> Model:
    """A linear model from toxic and unlabelled texts, and the share of toxic ones among the unlabelled."""
    if not positives or not unlabelled:
        return Model({}, float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))))
    marks = np.zeros(1 << 22, np.int32)  # a rough count by hash spares counting most words by name
    for t in positives:
        marks[np.unique([_mark(f) for f in features(t)])] += 1
    in_p = Counter(f for t in positives for f in features(t) if marks[_mark(f)] >= 3)
    often = sorted(f for f, n in in_p.items() if n >= 3)
    in_u = Counter(chain.from_iterable(features(t).intersection(in_p) for t in unlabelled))
    n_p, n_u = len(positives), len(unlabelled)
    a, b = (np.array([c[f] for f in often], float) for c in (in_p, in_u))
    mean = (a + b) / (n_p + n_u)
    contrast = (a / n_p - b / n_u) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    order = sorted(zip(-contrast, often, strict=True))[:FEATURES]
    chosen = {f: j for j, (c, f) in enumerate(order) if c < -4.5}
    if not chosen:
        return Model({}, float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))))
    rows, columns = [], []
    for i, t in enumerate(chain(positives, unlabelled)):
        hits = [chosen[f] for f in features(t) & chosen.keys()]
        rows += [i] * len(hits)
        columns += hits
    rows, columns, n = np.array(rows), np.array(columns), n_p + n_u
    is_p = np.arange(n) < n_p
    w, bias = np.zeros(len(chosen) + 1), float(np.log(prior / (1 - prior)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = bias
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[columns], n) + w[-1]
        s = 1 / (1 + np.exp(-z))
        loss_0 = np.logaddexp(0, z)
        negative = loss_0[~is_p].mean() - prior * loss_0[is_p].mean()
        # derivative of each part of the risk by the score of each text
        d_positive = np.where(is_p, prior * (s - 1) / n_p, 0.0)
        d_negative = np.where(is_p, -prior * s / n_p, s / n_u)
        d = d_positive + d_negative if negative >= 0 else -d_negative
        g = np.append(np.bincount(columns, d[rows], len(chosen)), d.sum())
        g[:-1] += SHRINK * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(w[j]) for f, j in chosen.items()}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the documents that are not held out. Rows of ``labels`` without an id or a label count for none.

    An id with several labels is toxic if one of them says so, and one with several texts gives one. The prior is the share of toxic ids among all
    labelled ids that are not held out, kept within 0.01 and 0.9.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = each.agg(F.avg("toxic")).first()[0]
    prior = min(max(share or 0.0, 0.01), 0.9)
    texts = docs.filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))

    def sample(ids: DataFrame, n: int) -> list[bytes]:
        chosen = smallest_hashes(ids.select("doc_id").distinct(), ["doc_id"], n)
        # at most n ids, so the broadcast is bounded; of an id that repeats, the text of smallest hash
        found = texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        each_once = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        return [(r.text or "").encode() for r in each_once.orderBy("doc_id").collect()]

    return train(sample(each.filter("toxic = 1"), POSITIVES), sample(texts, UNLABELLED), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row, from the text alone. NULL texts are empty; repeated rows and NULL ids are kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
