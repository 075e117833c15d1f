"""Pairs that are contracted many at a time, against the library, with given and with drawn ranks."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from blockquery.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANDOM = random.Random(5)
SYLLABLES = ["er", "th", "ing", "ich", "éau", "ß", "sch", "en", "aa", "qu", "x", "tion", "eau", "1", "哈"]


def ids_of(path, words):
    return [list(map(int, i.split())) for i in byte_bpe.encode_words(path, [w.encode() for w in words])[0]]


def library_ids(ranks, words):
    plain = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return [plain.encode_ordinary(w) for w in words]


def drawn_words(n, parts, most):
    return list({"".join(RANDOM.choices(parts, k=RANDOM.randrange(1, most))) for _ in range(n)})


def test_most_words_need_no_query_of_one_contraction_a_round(monkeypatch):
    words = [" " + w for w in drawn_words(5000, SYLLABLES, 6)]
    # a second query that leaves all as it is: the ids of words that came to it with pairs to contract are wrong
    monkeypatch.setattr(byte_bpe, "ENCODE", "SELECT w, pos, tok FROM start")
    found = ids_of(PATH, words)
    assert sum(a == b for a, b in zip(found, library_ids(byte_bpe.read_ranks(PATH), words), strict=True)) > 0.7 * len(words)


def test_words_of_the_given_ranks():
    words = drawn_words(5000, SYLLABLES, 9) + drawn_words(5000, "aeinrst", 14) + drawn_words(500, ["a", "aa", "ab"], 40)
    assert ids_of(PATH, words) == library_ids(byte_bpe.read_ranks(PATH), words)


def drawn_ranks(ordered):
    """Ranks of all bytes and of tokens joined from two others, in the order of joining or in any."""
    tokens = [b.encode() for b in "abc"]
    while len(tokens) < 60:
        token = RANDOM.choice(tokens) + RANDOM.choice(tokens)
        if token not in tokens and len(token) < 9:
            tokens.append(token)
    made = tokens[3:]
    if not ordered:
        RANDOM.shuffle(made)
    return {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + made)}


@pytest.mark.parametrize("ordered", [True, False])
def test_words_of_drawn_ranks(ordered, tmp_path):
    seen = set()
    for n in range(25):
        ranks = drawn_ranks(ordered)
        path = tmp_path / str(n)
        path.write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(t), r) for t, r in ranks.items()))
        words = drawn_words(400, "abc", 24) + ["a" * 30, "ab" * 20, "abc" * 10]
        assert ids_of(str(path), words) == library_ids(ranks, words)
        seen.add(byte_bpe._vocabulary(str(path)).ordered)
    assert ordered in seen


def test_long_words_among_short_ones_keep_their_places():
    words = ["".join(RANDOM.choices("abcdefgh", k=k)) for k in (3, 600, 5, 513, 700, 1, 512)]
    assert ids_of(PATH, words) == library_ids(byte_bpe.read_ranks(PATH), words)
