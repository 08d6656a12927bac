"""Disguises of any length, alone in a text, and many of them."""

import random
import time

import pytest

from bifolio.llm import pii


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("call plus 49 170 1234567", "phone", "plus 49 170 1234567"),
        ("llame al MÁS 34 612345678", "phone", "MÁS 34 612345678"),
        ("write to john.doe at example.com", "email", "john.doe at example.com"),
        ("write to john  arroba  mail.example.com", "email", "john  arroba  mail.example.com"),
        ("jane at example.com", "email", "jane at example.com"),
        ("plus 49 30 1234567", "phone", "plus 49 30 1234567"),
        ("card:four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card", "four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
        ("'ſix 0 1 1 0 0 0 9 9 0 1 3 9 4 2 4'", "card", "ſix 0 1 1 0 0 0 9 9 0 1 3 9 4 2 4"),
        ("a" * 500 + " at " + "b" * 300 + " dot c", "email", "a" * 500 + " at " + "b" * 300 + " dot c"),
        ("me at " + "x dot " * 40 + "org", "email", "me at " + "x dot " * 40 + "org"),
    ],
)
def test_no_other_trigger(text, kind, part):
    a = text.index(part)
    assert pii.spans(text) == ([], [(a, a + len(part), pii.KINDS.index(kind))])


def naive(text):
    """All spans, with the additions tested against every base span."""
    base, tape = pii.base_spans(text), pii.undisguised(text)
    added = [(*tape.source(a, b), k) for a, b, k in pii.base_spans(tape.text)]
    return sorted(base + [x for x in added if not any(x[2] == k and x[0] < b and a < x[1] for a, b, k in base)], key=lambda s: (s[0], s[2], s[1]))


def test_random_disguises():
    r = random.Random(10)
    some = ["plus", "MÁS", "at", "At", "arroba", "dot", "punKt", "punto", "one", "ſix", "Sıx", "FİVE", "zwei", "2", "49", "170", "1234567", "john.doe", "example.com", "j@x.org", "10.0.0.1", "4111111111111111", "+49 30 123456", "mail", "a-b", "@", ".", "(", ")", "[at]", "(dot)", ",", "/", "-", "_", ":", "'", " ", "  ", "\t", "\n", "é", "＠", "а", "\u200b", "x"]
    found = 0
    for _ in range(5000):
        t = "".join(r.choice(some) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(1, 12)))
        base, every = pii.spans(t)
        assert every == naive(t) and base == pii.base_spans(t), t
        found += len(every) > len(base)
    assert found > 30


def test_many_addresses():
    text = " ".join(f"user{i}@mail{i}.com" for i in range(20_000)) + " jane (at) example (dot) org"
    began = time.process_time()
    base, every = pii.spans(text)
    assert len(base) == 20_000 and len(every) == 20_001
    assert time.process_time() - began < 2


def test_long_texts_take_linear_time():
    for text in (" " * 10**6, "a" * 10**6 + " at b", "x " * 300_000, "a at " * 100_000, "(" * 300_000, "one " * 100_000, "a@" * 200_000, "\t" * 10**6, " \t" * 500_000, "(" + " " * 10**6, "(at" + " \t" * 500_000, "1" + " " * 10**6 + "dot", "a" + " " * 10**6 + "at", "( " * 300_000, "(at) " * 100_000):
        began = time.process_time()
        pii.spans(text)
        assert time.process_time() - began < 10, text[:5]


def test_framed_words_in_a_row():
    for text in ("a (at) (dot) b", "a (at) (at) b.c", "a\t \t[at]\t\tb {dot} com", "( at )x", "  (dot)  (dot)  "):
        assert pii.spans(text)[1] == naive(text)
    assert [m.span() for m in pii._AT_FRAMED.finditer("a  (at) \t(at)b (x) (at)")] == [(1, 9), (9, 13), (18, 23)]
