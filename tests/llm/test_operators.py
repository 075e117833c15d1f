"""Each operator against a plain version, on small tables with every odd case, and on empty tables."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockquery.llm import byte_bpe, common, language_model, neighbours, packing, private_data, quality, repeats, simhash, toxicity, warc
from tests.llm import frames

SPACE = rb"[^\x20\x09-\x0D]+"


def encoded(text):
    return (text or "").encode()


@pytest.fixture(scope="module")
def docs(spark):
    return frames.documents(spark).cache()


def groups(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def smallest(ids, root):
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def ordered(pairs):
    return sorted(pairs, key=lambda p: tuple((x is None, x) if not isinstance(x, tuple) else (False, x) for x in p))


# 1


def plain_fingerprint(text, words):
    found = re.findall(SPACE, text.lower())
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius,parts", [(2, 4), (9, 1)])
def test_simhash(docs, radius, parts):
    rows = frames.rows()
    prints = [plain_fingerprint(encoded(r[1]), 3) for r in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)
    expected = ordered(zip([r[0] for r in rows], prints, smallest([r[0] for r in rows], root)))
    found = simhash.near_duplicates(docs, words=3, radius=radius, parts=parts).collect()
    assert ordered((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == expected


def test_links_of_numbers_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60).tolist()
    flipped = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in [rng.choice(64, 2, replace=False)]]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in {*base, *flipped}]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    for parts in (1, 4):
        found = {frozenset(r) for r in simhash.links(prints, 2, parts, common.Steps(spark, "test")).collect()}
        close = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
        assert found == close and len(close) >= 60


def test_similar_documents(docs):
    rows = frames.rows()

    def shingles(text):
        found = encoded(text).lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = [shingles(r[1]) for r in rows]

    def alike(i, j):
        both = len(sets[i] | sets[j])
        return not both or len(sets[i] & sets[j]) >= 0.8 * both

    root = groups(len(rows), alike)
    expected = ordered(zip([r[0] for r in rows], smallest([r[0] for r in rows], root)))
    assert ordered(map(tuple, simhash.similar_documents(docs).collect())) == expected


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    found = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long"), common.Steps(spark, "test")).collect()))
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in [*range(101, 140), 200]}}


# 2


def test_quality(docs):
    found = quality.weak_quality(docs, carry=["doc_id", "text", "votes"]).collect()
    assert len(found) == len(frames.rows())
    for r in found:
        text = r.doc.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        expected = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_repeated_words_beyond_two_million(spark):
    n = 2_100_000  # the window at 3 is found again behind the place of 2 ** 21
    words = [f"{i:x}" for i in range(n)]
    words[-10:-7] = words[3:6]
    data = spark.createDataFrame([(" ".join(words),)], "text string").select(F.split("text", " ").alias("words"))
    assert data.select(quality.n_repeat_words(F.col("words"))).first()[0] == 6


def test_vote_posteriors_follow_the_plain_algorithm(spark):
    patterns = {(1, 0, 0): 70, (1, -1, 0): 5, (0, -1, -1): 20, (0, 0, 0): 5}
    data = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, rows long")
    accuracy = [0.8] * 3

    def believe(votes):
        return 1 / (1 + math.exp(-sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))))

    for _ in range(quality.ROUNDS):
        good = {v: believe(v) for v in patterns}
        accuracy = [
            min(max((2 + sum(n * (good[v] if v[j] > 0 else 1 - good[v]) for v, n in patterns.items() if v[j])) / (3 + sum(n for v, n in patterns.items() if v[j])), 0.6), 0.99)
            for j in range(3)
        ]
    for r in quality.vote_posteriors(data, 3).collect():
        assert r.posterior == pytest.approx(believe(r.votes), abs=1e-9)


# 3


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(600)]
    vectors += [(600 + i, vectors[50][1]) for i in range(30)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (None, [1.0] * 16), vectors[50]]
    data = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, tree int")
    found = defaultdict(list)
    for r in neighbours.search(data, data.filter("vec_id % 50 = 0"), 5).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    usable = {i: np.array(v) for i, v in vectors if i is not None and i < 900}
    hits = 0
    queries = [i for i in usable if i % 50 == 0]
    assert sorted(found) == sorted(queries)
    for q in queries:
        cosine = {i: (usable[q] * v).sum() / (np.sqrt((usable[q] ** 2).sum()) * np.sqrt((v**2).sum())) for i, v in usable.items() if i != q}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(g[2] == cosine[g[1]] for g in got)
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hits += len(set(best) & {g[1] for g in got})
    assert hits >= 0.9 * 5 * len(queries)
    assert neighbours.search(data.filter("false"), data.filter("false")).count() == 0
    assert neighbours.search(data.filter("vec_id < 3"), data.filter("vec_id = 0")).count() == 2


# 4


def test_toxicity(spark):
    bad = ["vile", "scornful", "wretched"]
    texts = [(i, frames.text(60, i) + (" " + " ".join(bad[i % 3] for _ in range(3)) if i % 4 == 0 else "")) for i in range(400)]
    data = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(data, toxicity.fit(data, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((scored[i] >= 0.3) == (i % 4 == 0) for i in held)
    model = toxicity.fit(data, labels.filter("false"))
    out = toxicity.score(frames.documents(spark), model).collect()
    assert len(out) == len(frames.rows()) and all(0 <= r.score <= 1 for r in out)
    flags = frames.documents(spark).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in flags)


def test_toxicity_samples_one_text_of_an_id(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda positives, unlabelled, prior: seen.update(p=positives, u=unlabelled))
    monkeypatch.setattr(toxicity, "UNLABELLED", 30)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, f"text {i} {k}") for i in ids for k in range(50 if i in ids[:20] else 1)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i in ids[:5])) for i in ids], "doc_id long, quality int, toxic int")
    toxicity.fit(data, labels)
    assert len(seen["p"]) == 5 and len(seen["u"]) == len({t.split()[1] for t in seen["u"]}) == 30


# 5


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    expected = []
    for r in frames.rows():
        ids = plain.encode_ordinary(r[1] or "")
        expected.append((r[0], " ".join(map(str, ids)), len(ids), bytes(encoded(r[1]))))
    found = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert ordered((r.doc_id, r.ids, r.n_tokens, bytes(r.decoded)) for r in found) == ordered(expected)


# 6


def test_language_model(docs):
    rows = [(r[0], [*re.findall(SPACE, encoded(r[1]).lower()), None]) for r in frames.rows()]

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    count = Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(count.values()), len(count)
    expected = ordered((i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in rows)
    found = language_model.score(docs).collect()
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    known = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in known) > 1.1 * sum(r.base_score for r in known)


@pytest.mark.parametrize("head", [0, 5])
def test_counts_beyond_the_frequent_words_are_joined(docs, head, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in language_model.score(docs).collect()}
    monkeypatch.setattr(language_model, "HEAD", head)
    assert {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in language_model.score(docs).collect()} == whole


# 7


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_warc(spark, min_bytes):
    html = ["<p>same page of some length</p>", "", "<p>é</p>", None, "x" * 100_000]
    pages = [(i, f"http://e.org/{i}?a= b\r\n", html[i % 5]) for i in range(40)] + [(40, None, "alone"), (None, None, html[0]), (None, "u", "only without id"), (3, "u", "")]
    data = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    expected = []
    for i, _, h in pages:
        data_of = encoded(h)
        other = first[h or ""] if len(data_of) >= min_bytes else None
        revisit = other is not None and other != i
        expected.append((i, len(data_of), base64.b32encode(hashlib.sha1(data_of).digest()).decode(), "revisit" if revisit else "response", other if revisit else None))
    assert ordered(map(tuple, warc.round_trip(data, min_bytes).collect())) == ordered(expected)
    assert warc.round_trip(data.filter("false")).count() == 0


# 8


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    expected = []
    for r in frames.rows():
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        cuts = [ids[s : s + 128] for s in range(0, len(ids), 128)]
        expected += [(r[0], k, 128 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cuts)]
    packed = packing.pack(packing.pieces(docs, path, size=128), size=128).collect()
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == ordered(expected)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    total = sum(e[3] for e in expected)
    assert total <= 128 * len(bins) <= 1.05 * total
    assert packing.pack(packing.pieces(docs.filter("false"), path, size=128), size=128).count() == 0


def test_words_have_the_ids_of_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["It's DON'T stop!!", "a.b.c, (d). 'e'.f", "ÉTÉ, Straße; x² 3.14% 10$&", "é. “quote.” ok no.", "<|endoftext|>? x", "##** .,. !a!"]
    plain.encode_special_tokens = True
    found = [ids.tolist() for ids in packing.WordIds(path).ids([t.encode() for t in texts])]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_exchange_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 40)
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 101, 400).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    packed = packing.pack(cut, 100).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(lengths))
    one = len(packing.best_fit(np.sort(np.array(lengths))[::-1], 100)[2])
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= one and len({r.sequence_id for r in packed}) <= one + 10
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


# 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e x@y z@@q.r .@a.b a@b..c é@b.co u.v+w@x-y.zz.",
        "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4 1.2.3",
        "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-0 12345678901234567890",
        "+1 (269) 555-3296 +1 +12 +123456789012345678 +4930 123456",
        "",
    ],
)
def test_base_spans(text):
    assert private_data.base_spans(text) == plain_spans(text)


def test_private_data(spark):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(120):
        secret = "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
        texts.append((i, f"{frames.text(20, i)} {secret} {frames.text(5, i)} item{i} of 4.0. mail me{i}@e.org now" if i % 2 else f"{frames.text(30, i)} part{i}b, a{i}"))
    data = spark.createDataFrame(texts, "doc_id long, text string")
    model = private_data.fit(data)
    by_id = {r.doc_id: r.spans for r in private_data.find(data, model).collect()}
    for i, t in texts:
        assert [s.kind for s in by_id[i]] == (["email", "secret"] if i % 2 else [])
        assert [t[s.start : s.end][:4] for s in by_id[i] if s.kind == "secret"] == (["AKIA"] if i % 2 else [])
    assert "AKIA" not in "".join(r.text for r in private_data.redacted(data, model).collect())
    docs = frames.documents(spark)
    out = private_data.redacted(docs, private_data.fit(docs))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert private_data.find(docs, model).count() == docs.count()
    assert private_data.redact("abcdef", [("x", 1, 3), ("y", 2, 4), ("z", 5, 6)]) == "a[X]e[Z]"


def test_private_data_of_rare_forms_and_texts_without_joints(spark):
    rng = np.random.default_rng(19)
    texts = [f"{frames.text(12, i)} order{i}abcdef {frames.text(4, i)} 2024 10 {1000 + i}" for i in range(300)]
    numbers = [f"{frames.text(9, i)}, {rng.integers(100, 999)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)} {frames.text(5, i)}" for i in range(40)]
    secret = "ghp_" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789"), 36))
    texts += [*numbers, f"{frames.text(9, 1)} {secret} {frames.text(9, 2)}", *[texts[0]] * 200]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in private_data.find(data, private_data.fit(data)).collect()}
    assert all(found[i] == ["number"] for i in range(300, 340)) and found[340] == ["secret"]
    assert not any(found[i] for i in [*range(300), *range(341, 541)])
    alone = data.filter("doc_id BETWEEN 300 AND 339")  # no candidate without a label
    assert all([s.kind for s in r.spans] == ["number"] for r in private_data.find(alone, private_data.fit(alone)).collect())


# 10


def plain_kept(rows):
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(text) - 49):
            first.setdefault(text[k : k + 50], i)
    out = []
    for i, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - 49) if i is not None else ():
            if first[text[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, bytes(b for b, g in zip(text, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize("hot,group", [(20_000, 20_000), (1, 20_000), (20_000, 1)])
def test_repeats(spark, monkeypatch, hot, group):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = frames.rows()
    passage = frames.text(40, 77)
    for k in range(12):  # a common passage in different contexts, and overlapping parts of it
        rows.append((100 + k, frames.text(8, 700 + k) + passage[3 * k : 3 * k + 100] + frames.text(8, 800 + k), "en", "s", 0))
    rows += [(120, "\0" * 120, "en", "s", 0), (121, "\0" * 60 + "b" * 60, "en", "s", 0), (122, rows[1][1], "en", "s", 0), (122, rows[2][1] + "!", "en", "s", 0)]
    found = repeats.without_repeats(frames.documents(spark, rows)).collect()
    expected = ordered(plain_kept([(r[0], encoded(r[1])) for r in rows]))
    assert ordered((r.doc_id, bytes(r._kept), r._n_removed, r._n_spans) for r in found) == expected


def test_maximal_repeats_of_segments():
    a, b = b"x" + b"0123456789" * 5 + b"AB", b"y" + b"0123456789" * 5 + b"AC"
    of, offset, length, document = repeats.maximal_repeats([a, b], np.array([1, 2]), np.array([1, 2]))
    assert sorted(zip(of, offset, length, document)) == [(1, 1, 51, 1)]


def test_empty_table(spark):
    none = frames.documents(spark).filter("false")
    assert simhash.near_duplicates(none).count() == simhash.similar_documents(none).count() == 0
    assert quality.weak_quality(none).count() == repeats.without_repeats(none).count() == 0
    assert language_model.score(none).count() == 0
    assert private_data.find(none, private_data.fit(none)).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0
