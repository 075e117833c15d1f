"""Private data in long texts, runs of digits and many spans: within seconds, and as a plain search finds it."""

import re
import time

from blockquery.llm import private_data

ACCEPT = private_data.Model(9.0, (), {k: 0.5 for k in private_data.KINDS})
PLAIN_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def timed(text):
    began = time.time()
    found = private_data.spans_of([text], ACCEPT)[0]
    assert time.time() - began < 30
    return found


def test_a_million_digits():
    assert timed("7" * 1_000_000) == [("number", 0, 1_000_000)]


def test_zeros_before_a_part():
    assert ("ip", 0, 10_007) in timed("0" * 10_000 + "1.2.3.4")


def test_many_spans_in_one_text():
    found = timed("tok3nabcdefg 10.0.0.1 " * 50_000)
    assert [k for k, _, _ in found].count("ip") == 50_000 and [k for k, _, _ in found].count("secret") == 50_000


def test_many_capitals_beside_tokens():
    found = timed(("A" * 20 + " " + "B" * 20 + "1 ") * 20_000)
    assert [k for k, _, _ in found].count("secret") == 40_000


def test_addresses_are_those_of_the_plain_pattern():
    texts = ["1.2.3.4.5.6.7.8", "11.22.33", "1.2.3.4.", "..1.2.3.256.1.1.1", "a1.1.1.1b", "1.1.1.1.1.1.1", "999.1.1.1.1 01.002.3.4", "12.3.4.5-6.7.8.9"]
    for text in texts:
        plain = [m.span() for m in PLAIN_IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [(a, b) for k, a, b in private_data.base_spans(text) if k == "ip"] == plain
