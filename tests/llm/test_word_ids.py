"""Ids by words are the ids of whole texts, with the library's own settings."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from blockquery.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    texts = ["a <|startoftext|> b", "a<|startoftext|>b.", "<|endoftext|>? x", "<|EndOfText|>. <|ENDOFTEXT|>", "x<|endoftext|>ABC., <|endoftext|", "İ% tİ: İ* İstanbul.", "ÉTÉ. é. ß!"]
    rng = random.Random(8)
    letters = "abİÉß1²日éǅΣς.,!?;:%*$#&'-  "
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(30_000)]
    found = packing.WordIds(PATH, plain=False).ids([t.encode() for t in texts])
    expected = library.encode_batch(texts, add_special_tokens=False)
    wrong = [(t, ids.tolist(), e.ids) for t, ids, e in zip(texts, found, expected, strict=True) if ids.tolist() != e.ids]
    assert not wrong, wrong[:5]


def test_words_of_plain_letters_are_encoded_many_at_a_time(monkeypatch):
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randrange(1, 12))) for _ in range(20_000)})
    ids = packing.WordIds(PATH, plain=False)
    sent = []

    class Counted:
        def encode_batch_fast(self, texts, **kinds):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **kinds)

    library, ids.tokenizer = ids.tokenizer, Counted()
    found = list(ids.ids([" ".join(words).encode(), b"", b"It's x2 caf\xc3\xa9."]))
    expected = Tokenizer.from_file(PATH).encode_batch([" ".join(words), "", "It's x2 caf\u00e9."], add_special_tokens=False)
    assert [f.tolist() for f in found] == [e.ids for e in expected]
    assert len(sent) < len(words) / 20
    monkeypatch.setattr(ids, "ends", None)
    ids.clear()
    assert [f.tolist() for f in ids.ids([" ".join(words[:50]).encode()])] == [Tokenizer.from_file(PATH).encode(" ".join(words[:50]), add_special_tokens=False).ids]
