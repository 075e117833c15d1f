"""Byte-pair encoding of words far longer than a block, against the library, by the time and the ids."""

import random
import time

import public_tokenizers
import pytest
import tiktoken

from blockquery.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
RANDOM = random.Random(7)
WORDS = {
    "random": "".join(RANDOM.choices(LETTERS, k=100_000)),
    "one letter": "a" * 100_000,
    "period of three": "abc" * 30_001,
    "three bytes": "哈" * 30_000,
    "dashes": "-" * 50_000,
    "a token and a letter": "the" * 700 + "q" + "the" * 700,
}


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("name", WORDS)
def test_long_words(plain, name):
    word = WORDS[name]
    began = time.time()
    ids, n, back = byte_bpe.encode_words(PATH, [word.encode()])
    assert time.time() - began < 60
    assert list(map(int, ids[0].split())) == plain.encode_ordinary(word)
    assert n == [len(ids[0].split())] and back == [word.encode()]


def test_words_around_the_limits_of_blocks(plain):
    words = ["".join(RANDOM.choices(RANDOM.choice(["abc", "the ", "qxz", LETTERS]), k=k)).replace(" ", "") for k in (511, 512, 513, 640, 641, 1023, 1025)]
    ids, _, back = byte_bpe.encode_words(PATH, [w.encode() for w in words])
    assert [list(map(int, i.split())) for i in ids] == [plain.encode_ordinary(w) for w in words]
    assert back == [w.encode() for w in words]
