"""Alignment of two tokenizers against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockquery.llm import alignment
from tests.llm import frames

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spelled(libraries, text):
    """Ids and bytes of both sides, from the library's encoding of the whole text; None without tokens."""
    a, b = libraries
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_character = alignment.byte_characters()
    bytes_a = [bytes(map(of_character.__getitem__, a.id_to_token(i))) for i in ids[0]]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    whole = (" " + text).encode()
    return (ids, (bytes_a, bytes_b)) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def ranges(parts):
    out, start = [], 0
    for p in parts:
        out.append((start, start + len(p)))
        start += len(p)
    return out


def plain(libraries, texts):
    """``(n_a, n_b, n_groups, links, groups as text)`` of each text."""
    out = []
    for text in texts:
        found = spelled(libraries, text)
        if found is None:
            out.append((0, 0, 0, [], ""))
            continue
        (ids_a, ids_b), parts = found
        at_a, at_b = map(ranges, parts)
        links, j = [], 0
        for i, (start, end) in enumerate(at_a):
            while at_b[j][1] <= start:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][0] < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        common = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, before = [], 0
        by_end = [defaultdict(list), defaultdict(list)]
        for side, (ids, at) in enumerate(((ids_a, at_a), (ids_b, at_b))):
            place = 0
            for i, (_, end) in zip(ids, at):
                while common[place] < end:
                    place += 1
                by_end[side][place].append(str(i))
        groups = [",".join(by_end[0][g]) + "|" + ",".join(by_end[1][g]) for g in range(len(common))]
        out.append((len(ids_a), len(ids_b), len(common), links, ";".join(groups)))
    return out


def expected_rows(libraries, ids, texts):
    found = plain(libraries, texts)
    count = Counter(link for f in found for link in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (str(i), n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), groups)
        for i, (n_a, n_b, n_groups, links, groups) in zip(ids, found)
    )


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


@pytest.mark.parametrize("chunk,known", [(alignment.CHUNK, alignment.KNOWN_WORDS), (300, 5)])
def test_align(spark, libraries, monkeypatch, chunk, known):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "KNOWN_WORDS", known)
    monkeypatch.setattr(alignment, "BATCH", 200 if chunk == 300 else alignment.BATCH)
    rows = frames.rows()
    rows += [(300 + i, t, "en", "s", 0) for i, t in enumerate(["a <|endoftext|> b </s> <unk> <0x0A>", "half▁blank", "line\n\n end \t. ", " ", "\n", "x\r\n y  z", "tab\tand\x1cother\x85space", "İ% tİ: 日本語", "\x00 zero"])]
    docs = frames.documents(spark, rows)
    expected = expected_rows(libraries, [r[0] for r in rows], [r[1] for r in rows])
    found = alignment.align(docs, *PATHS)
    assert rows_of(found) == expected
    hashed = alignment.align(docs, *PATHS, digest=True).select("doc_id", "groups")
    digests = sorted((i, hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, *_, groups in expected)
    assert sorted((str(r.doc_id), r.groups) for r in hashed.collect()) == digests


def test_words_are_tokens_of_the_whole_text(libraries):
    rng = random.Random(3)
    letters = "ab Zé's 12.,\n\t\r\x1c\x85 　İ日𝒳<s>|​́" + " " * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(frames.WORDS) + rng.choice([" ", "\n", ".", "", "  "]) for _ in range(50)) for _ in range(50)]
    counts, groups, _, _ = alignment.aligned(alignment.Pair(*PATHS), texts, False)
    expected = plain(libraries, texts)
    assert groups == [e[4] for e in expected]
    assert list(zip(*(c.tolist() for c in counts))) == [(e[0], e[1], e[2], len(e[3])) for e in expected]


def test_long_words_take_time_in_proportion(libraries):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(100_000))
    counts, groups, _, _ = alignment.aligned(alignment.Pair(*PATHS), [text], False)
    assert groups == [plain(libraries, [text])[0][4]]


def test_empty_table(spark):
    docs = frames.documents(spark, [])
    assert alignment.align(docs, *PATHS).collect() == []
    nothing = frames.documents(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])
    assert rows_of(alignment.align(nothing, *PATHS)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]


def test_other_columns_are_not_read(spark):
    docs = frames.documents(spark).withColumn("chunk", F.lit(1)).withColumn("pairs", F.lit("x"))
    assert set(alignment.align(docs, *PATHS).columns) == {c.split()[0] for c in alignment.TEXTS.split(", ")}
