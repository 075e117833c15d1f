"""Language of texts in two steps: the family first, then the languages of that family against each other.

Features are byte n-grams of letters in lower case, hashed to ``BUCKETS`` and counted over the whole text; a text is
the vector of the square roots of its counts, at unit length. One linear support vector machine a family tells it from
the rest, and within a family one a pair of languages. A text goes to the likeliest family, and there to
the language that wins most duels.

Learning is spread over Spark: the sample (``SAMPLE`` distinct texts of smallest hash of each language, at most) is
written as sparse features, each row is copied to the problems it takes part in, and each problem is a group of
bounded size that one task solves by coordinate descent on the dual. Machines are calibrated on margins of texts they
have not seen. Only their weights reach the driver. Scoring is one narrow pass over whole texts in numpy batches.

Families of common language codes are fixed values below. Languages without one join the family whose texts are most
like theirs; if no language has one, all are one family.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from blockquery.llm.common import Steps, batches_of

# Language codes of two letters by family.
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "dravidian": "kn ml ta te",
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "malay": "id jv mg ms su tl",
    "romance": "ca co es fr gl it la oc pt ro",
    "semitic": "am ar he mt ti",
    "sinitic": "zh",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
}

SAMPLE = 500
"""Texts of each language to learn from, at most."""

FAMILY_SAMPLE = 4000
"""Texts of all languages together that a family is told from the rest by, at most."""

PARTS = 64
"""Parts of a language of which the smallest hashes are taken separately."""

BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20
"""Bytes whose n-grams are counted at once."""

COST, EPOCHS, FOLDS = 4.0, 200, 3
UNKNOWN = "und"

_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def plain_letters(text: str | None) -> bytes:
    """UTF-8 of the text in lower case, with one space in place of ASCII characters that are no letters, and around."""
    return b" " + b" ".join((text or "").lower().encode().translate(_SPACED).split()) + b" "


def counts_of(texts: list[bytes]) -> np.ndarray:
    """How many n-grams of each text fall into each bucket; texts are cut into pieces, but their n-grams are not."""
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    reach = max(ORDERS) - 1
    pieces = [(i, t[s : s + PIECE + reach]) for i, t in enumerate(texts) for s in range(0, len(t), PIECE)]
    first = 0
    while first < len(pieces):
        last, size = first, 0
        while last < len(pieces) and (last == first or size + len(pieces[last][1]) <= PIECE):
            size += len(pieces[last][1])
            last += 1
        part = pieces[first:last]
        lengths = np.array([len(p) for _, p in part])
        piece = np.repeat(np.arange(len(part)), lengths)
        own = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths) < PIECE
        text = np.array([i for i, _ in part])[piece] * BUCKETS
        data = np.frombuffer(b"".join(p for _, p in part), np.uint8).astype(np.uint32)
        code = np.zeros(size, np.uint32)
        for n in range(1, max(ORDERS) + 1):
            end = size - n + 1
            if end <= 0:
                break
            code = (code[:end] << np.uint32(8)) | data[n - 1 :]
            if n in ORDERS:
                bucket = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 13)
                inside = own[:end] & (piece[:end] == piece[n - 1 :])
                counts += np.bincount((text[:end] + bucket)[inside], minlength=len(counts))
        first = last
    return counts.reshape(len(texts), BUCKETS)


def vectors_of(texts: list[bytes]) -> np.ndarray:
    """Square roots of the counts, each text at unit length."""
    x = np.sqrt(counts_of(texts), dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass(frozen=True)
class Machine:
    """A linear classifier and the line that turns its margins into log odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the support vector machine by coordinate descent on its dual; both classes weigh the same."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    bound = np.where(signs > 0, 0.5 / (signs > 0).sum(), 0.5 / (signs < 0).sum()) * len(rows) * COST
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            marks, values = rows[i]
            gradient = signs[i] * (w[marks] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), bound[i])  # unit vectors and a bias of one: 2 on the diagonal
            step = (new - alpha[i]) * signs[i]
            if step:
                w[marks] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _line(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins, by Newton steps on smoothed targets."""
    n_p, n_n = positive.sum(), (~positive).sum()
    target = np.where(positive, (n_p + 1) / (n_p + 2), 1 / (n_n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        d, h = p - target, p * (1 - p) + 1e-6
        g = np.array([d @ margins + 1e-4 * (a - 1), d.sum()])
        hess = np.array([[h @ (margins * margins) + 1e-4, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def train(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> Machine:
    """A calibrated machine from sparse unit vectors ``(buckets, values)`` and their signs."""
    w, bias = _descend(rows, signs)
    fold = np.empty(len(rows), int)
    for sign in (1, -1):
        at = np.flatnonzero(signs == sign)
        fold[at] = np.arange(len(at)) % FOLDS
    margins = np.array([w[m] @ v + bias for m, v in rows])
    if min((signs > 0).sum(), (signs < 0).sum()) >= 2 * FOLDS:
        for k in range(FOLDS):
            seen = np.flatnonzero(fold != k)
            w_k, bias_k = _descend([rows[i] for i in seen], signs[seen])
            for i in np.flatnonzero(fold == k):
                margins[i] = w_k[rows[i][0]] @ rows[i][1] + bias_k
    return Machine(w.astype(np.float32), bias, *_line(margins, signs > 0))


@dataclass(frozen=True)
class Model:
    """Families with their languages, the machine of each family, and those of pairs of languages."""

    families: dict[str, list[str]]
    of_family: dict[str, Machine]
    of_pair: dict[tuple[str, str], Machine]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of unit vectors. The score is the odds of the family times those of its closest duel."""
        names = sorted(self.families)
        odds = np.column_stack([_likely(self.of_family[f], x) if f in self.of_family else np.ones(len(x)) for f in names])
        odds = odds / odds.sum(1, keepdims=True)
        chosen, score = odds.argmax(1), odds.max(1)
        out = np.empty(len(x), object)
        for f, name in enumerate(names):
            at, languages = np.flatnonzero(chosen == f), self.families[name]
            wins = np.zeros((len(at), len(languages)))
            closest = np.ones((len(at), len(languages)))
            total = np.zeros((len(at), len(languages)))
            for i, j in combinations(range(len(languages)), 2):
                p = _likely(self.of_pair[languages[i], languages[j]], x[at])
                for k, q in ((i, p), (j, 1 - p)):
                    wins[:, k] += q >= 0.5 if k == i else q > 0.5
                    total[:, k] += q
                    closest[:, k] = np.minimum(closest[:, k], q)
            best = (wins + total / (len(languages) + 1)).argmax(1)
            out[at] = np.array(languages, object)[best]
            score[at] *= closest[np.arange(len(at)), best]
        return out.tolist(), score


def _likely(machine: Machine, x: np.ndarray) -> np.ndarray:
    margins = (x @ machine.weights).astype(float) + machine.bias
    return 1 / (1 + np.exp(-np.clip(machine.slope * margins + machine.offset, -40, 40)))


SPARSE = "lang string, n int, marks binary, roots binary"


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """Of each language ``n`` distinct texts of smallest hash, numbered.

    Hashes are chosen without their texts, of parts of a language first, so no task sorts a whole language; texts are
    then picked where they are read. There are ``n`` choices a language, and the model grows with the languages too.
    """
    place = F.xxhash64("text").bitwiseAND((1 << 53) - 1).alias("place")
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", place).filter(F.col("text").rlike(r"\p{L}"))
    chosen = labelled.select(F.col("lang").alias("of"), F.col("place").alias("at")).distinct().withColumn("part", F.col("at") % PARTS)
    for by in (["of", "part"], ["of"]):
        chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("at"))).filter(F.col("n") <= n)
    picked = labelled.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (F.col("place") == F.col("at")))
    return picked.groupBy("lang", "n").agg(F.min("text").alias("text"))


def _sparse(sample: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, PIECE, "text"):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = vectors_of([plain_letters(t) for t in part.column(2).to_pylist()])
                at = [np.flatnonzero(row) for row in x]
                marks = [a.astype("<u2").tobytes() for a in at]
                roots = [row[a].astype("<f4").tobytes() for row, a in zip(x, at, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.binary()), pa.array(roots, pa.binary())], ["lang", "n", "marks", "roots"])

    return sample.mapInArrow(run, SPARSE)


def _rows_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs = zip(table.column("marks").to_pylist(), table.column("roots").to_pylist(), strict=True)
    return [(np.frombuffer(m, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for m, v in pairs]


def _solved(table: pa.Table) -> pa.Table:
    """One problem: its rows in an order that does not depend on the shuffle."""
    table = table.sort_by([("lang", "ascending"), ("n", "ascending")])
    machine = train(_rows_of(table), table.column("sign").to_numpy().astype(float))
    values = [table.column("problem")[0].as_py(), machine.weights.astype("<f4").tobytes(), machine.bias, machine.slope, machine.offset]
    return pa.table([[v] for v in values], names=["problem", "weights", "bias", "slope", "offset"])


def _mean(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS)
    for marks, values in _rows_of(table):
        total[marks] += values
    return pa.table([[table.column("lang")[0].as_py()], [total.astype("<f8").tobytes()]], names=["lang", "total"])


def families_of(languages: list[str], sample: DataFrame, known: Mapping[str, str]) -> dict[str, list[str]]:
    """Languages by family. ``known`` holds codes by family; others join the family of the language most like them."""
    family = {code: name for name, codes in known.items() for code in codes.split()}
    codes = {x: re.split(r"[-_]", x.lower())[0] for x in languages}
    found = {x: family[c] for x, c in codes.items() if c in family}
    others = [x for x in languages if x not in found]
    if others and found:
        totals = {r.lang: np.frombuffer(r.total, "<f8") for r in sample.groupBy("lang").applyInArrow(_mean, "lang string, total binary").collect()}
        unit = {x: t / max(np.linalg.norm(t), 1e-9) for x, t in totals.items()}
        listed = sorted(found)
        for x in others:
            found[x] = found[max(listed, key=lambda y: float(unit[x] @ unit[y]))]
    out: dict[str, list[str]] = {}
    for x in sorted(languages):
        out.setdefault(found.get(x, "other"), []).append(x)
    return out


def fit(docs: DataFrame, known: Mapping[str, str] = FAMILIES) -> Model:
    """The model from the texts of ``docs`` that have a language; other columns are not read.

    Rows without text, letter or language are not learned from, copies count once, and a text that has several languages
    counts for each. Without any row the model is empty and knows no language.
    """
    steps = Steps(docs.sparkSession, "languages")
    sample = steps.keep(_sparse(_sample(docs, SAMPLE)))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    families = families_of(languages, sample, known)
    share = max(1, FAMILY_SAMPLE // max(1, len(languages)))
    takes: list[tuple[str, str, int, int]] = []  # problem, language, sign, rows at most
    if len(families) > 1:
        takes += [(f"family\n{f}", x, 1 if x in own else -1, share) for f, own in families.items() for x in languages]
    for own in families.values():
        takes += [(f"pair\n{i}\n{j}", x, sign, SAMPLE) for i, j in combinations(own, 2) for x, sign in ((i, 1), (j, -1))]
    of_family: dict[str, Machine] = {}
    of_pair: dict[tuple[str, str], Machine] = {}
    if takes:
        table = docs.sparkSession.createDataFrame(takes, "problem string, of string, sign int, most int")
        rows = sample.join(table, (F.col("lang") == F.col("of")) & (F.col("n") <= F.col("most"))).drop("of", "most")
        solved = rows.groupBy("problem").applyInArrow(_solved, "problem string, weights binary, bias double, slope double, offset double")
        for r in solved.collect():
            machine = Machine(np.frombuffer(r.weights, "<f4"), r.bias, r.slope, r.offset)
            kind, *names = r.problem.split("\n")
            if kind == "family":
                of_family[names[0]] = machine
            else:
                of_pair[names[0], names[1]] = machine
    steps.drop(sample)
    return Model(families, of_family, of_pair)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from the whole text alone.

    ``und`` and zero where the text is NULL or has no letter, and everywhere if the model knows no language. Repeated
    rows and NULL ids are kept; very long texts are counted in pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, PIECE, "text"):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                known = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
                found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    languages, score[known] = model.predict(vectors_of([plain_letters(texts[i]) for i in known]))
                    for i, x in zip(known, languages, strict=True):
                        found[i] = x
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
