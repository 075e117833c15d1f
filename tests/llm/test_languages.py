"""Language identification: features and machines against plain versions, held-out accuracy, and every odd case."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from blockquery.llm import languages
from tests.llm import frames

# invented languages: endings and small words of their own; the first two are close to each other
SOUNDS = {
    "de": ("ung heit keit sch ein ver", "der die und ist"),
    "nl": ("ing heid keit sch een ver", "de het en is"),
    "fr": ("tion aux eur ment ique ai", "le la les et"),
    "es": ("cion os ador mente ica ue", "el la los y"),
    "xx": ("qzu zzo kwa uuk wex izz", "zo uz kwi"),
}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts, small = (x.split() for x in SOUNDS[lang])
    return " ".join(rng.choice(small) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(n=60):
    out = [(1000 * k + i, text(lang, 30 + i, i), lang, "s", 0) for k, lang in enumerate(SOUNDS) for i in range(n)]
    copy = text("fr", 40, 1)
    out += [(10_000 + i, copy, "fr", "s", 0) for i in range(400)]  # a group of copies
    out += [(20_000, None, "de", "s", 0), (20_001, "", "de", "s", 0), (20_002, "12 % 34", "de", "s", 0), (20_003, text("de", 5, 2).upper(), None, "s", 0)]
    out += [(None, text("es", 40, 3), "es", "s", 0), (None, None, None, None, None), (20_004, text("nl", 60_000, 4), None, "s", 0), (20_005, "日本語", None, "s", 0)]
    return out + [out[0], out[0]]


def plain_counts(t):
    return Counter((n, t[i : i + n]) for n in languages.ORDERS for i in range(len(t) - n + 1))


@pytest.mark.parametrize("piece", [languages.PIECE, 7, 1])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(languages, "PIECE", piece)
    texts = [languages.plain_letters(t) for t in ("Der Tag, und 12 die Nacht", "", None, "éÀ", "a", "xyz " * 40)]
    found = languages.counts_of(texts)

    def bucket(gram):
        return (int.from_bytes(gram, "big") * 2654435761 + len(gram) * 40503) % 2**32 >> 19

    for t, row in zip(texts, found):
        expected = Counter()
        for (_, gram), n in plain_counts(t).items():
            expected[bucket(gram)] += n
        assert {i: int(n) for i, n in enumerate(row) if n} == expected


def test_letters():
    assert languages.plain_letters("Ab1_C  é\n") == " ab c é ".encode()
    assert [languages.has_letter(t) for t in (None, "", "12 _ ½ ²", "1a", "日", "́")] == [False, False, False, True, True, False]


def test_machine_reaches_the_optimum():
    """The value of the primal problem is near that of the dual, so the machine is the best one."""
    rng = np.random.default_rng(1)
    signs = np.where(np.arange(80) < 30, 1.0, -1.0)
    data = []
    for s in signs:
        x = rng.normal(size=40) + 0.25 * s
        data.append((np.arange(40), x / np.linalg.norm(x)))
    w, bias = languages._descend(data, signs)
    x = np.array([v for _, v in data])
    cost = np.where(signs > 0, 0.5 / 30, 0.5 / 50) * 80 * languages.COST
    hinge = np.maximum(0, 1 - signs * (x @ w[:40] + bias))
    primal = 0.5 * (w @ w + bias * bias) + cost @ hinge

    def value(v):
        return 0.5 * v @ v + cost @ np.maximum(0, 1 - signs * (x @ v[:-1] + v[-1]))

    best, v = np.inf, np.append(w[:40], bias)
    for step in range(4000):  # a plain subgradient descent from there finds nothing much better
        on = signs * (x @ v[:-1] + v[-1]) < 1
        g = v - np.append((cost * signs * on) @ x, (cost * signs * on).sum())
        v = v - 0.002 / np.sqrt(step + 1) * g
        best = min(best, value(v))
    assert primal <= best * 1.01


def test_calibration():
    rng = np.random.default_rng(2)
    margins = rng.normal(size=4000)
    positive = rng.random(4000) < 1 / (1 + np.exp(-(2.5 * margins - 0.7)))
    slope, offset = languages._line(margins, positive)
    assert abs(slope - 2.5) < 0.3 and abs(offset + 0.7) < 0.2


def test_families(spark):
    docs = frames.documents(spark, rows(10))
    sample = languages._sparse(languages._sample(docs, 20))
    names = sorted(SOUNDS)
    assert languages.families_of(names, sample, languages.FAMILIES)["germanic"][:2] == ["de", "nl"]
    known = {"one": "de", "two": "fr"}
    assert languages.families_of(["de", "es", "fr", "nl"], sample, known) == {"one": ["de", "nl"], "two": ["es", "fr"]}
    assert languages.families_of(names, sample, {}) == {"other": names}
    assert languages.families_of(["EN-us", "en_GB", "de"], sample, languages.FAMILIES) == {"germanic": ["EN-us", "de", "en_GB"]}


def test_sample_holds_distinct_texts(spark):
    docs = frames.documents(spark, rows())
    found = languages._sample(docs, 25).collect()
    by_language = Counter(r.lang for r in found)
    assert set(by_language) == set(SOUNDS) and set(by_language.values()) == {25}
    assert len({(r.lang, r.text) for r in found}) == len(found)


@pytest.mark.parametrize("known", [languages.FAMILIES, {}, {"a": "de nl", "b": "fr es", "c": "xx"}])
def test_held_out_texts_are_told_apart(spark, known):
    data = rows()
    docs = frames.documents(spark, data)
    seen = docs.filter(~languages.held_out(docs["doc_id"]))
    found = languages.predict(docs, languages.fit(seen, known)).collect()
    assert len(found) == len(data)
    expected = {r[0]: r[2] for r in data if r[0] is not None and r[0] < 20_000} | {20_003: "de", 20_004: "nl"}
    right = [expected[r.doc_id] == r.lang_pred for r in found if r.doc_id in expected]
    apart = [expected[r.doc_id] == r.lang_pred for r in found if r.doc_id in expected and r.doc_id < 10_000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(right) > 0.99 and len(apart) > 80 and np.mean(apart) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    nothing = {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (20_000, 20_001, 20_002)}
    assert nothing == {i: ("und", 0.0) for i in (20_000, 20_001, 20_002)}
    assert sorted(r.lang_pred for r in found if r.doc_id is None) == ["es", "und"]
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id and 10_000 <= r.doc_id < 20_000}) == 1  # copies


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    data = rows(15)
    wrong = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else x, "other", n) for i, t, x, _, n in data]
    found = []
    for given in (data, wrong):
        docs = frames.documents(spark, given)
        model = languages.fit(docs.filter(~languages.held_out(docs["doc_id"])))
        found.append(sorted(map(str, languages.predict(docs, model).collect())))
    assert found[0] == found[1]


def test_few_languages_and_empty_tables(spark):
    one = frames.documents(spark, [r for r in rows(5) if r[2] == "de"])
    assert {r.lang_pred for r in languages.predict(one, languages.fit(one)).collect()} == {"de", "und"}
    two = frames.documents(spark, [(1, "der Tag", "de", "s", 0), (2, "le jour", "fr", "s", 0)])
    assert {r.doc_id: r.lang_pred for r in languages.predict(two, languages.fit(two)).collect()} == {1: "de", 2: "fr"}
    empty = frames.documents(spark, [])
    model = languages.fit(empty)
    assert languages.predict(empty, model).collect() == []
    assert {(r.lang_pred, r.score) for r in languages.predict(two, model).collect()} == {("und", 0.0)}
