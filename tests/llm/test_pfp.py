"""Prefix-free parsing, against a plain sort of all suffixes."""

import random

import pytest

from symgraph.llm import pfp


def documents(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abcdefghijklmnop", bytes(range(256)), b"\x00\x01\xff"])
    make = lambda n: bytes(rng.choice(letters) for _ in range(n))
    pool = [make(rng.randrange(0, 200)) for _ in range(4)]
    return [b"".join(rng.choice(pool)[: rng.randrange(0, 250)] + make(rng.randrange(0, 20)) for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(0, 12))] + [b"", b"a" * rng.randrange(0, 90)]


@pytest.mark.parametrize("seed", range(40))
def test_order_is_that_of_all_suffixes(seed):
    docs = documents(seed)
    c = pfp.Corpus(docs)
    suffix = [d[i:] for d in docs for i in range(len(d))]
    order = c.order().tolist()
    assert sorted(order) == list(range(len(suffix)))
    assert [suffix[i] for i in order] == sorted(suffix)


@pytest.mark.parametrize("seed", range(40))
def test_equal_strings(seed):
    docs = documents(seed)
    place, number = (x.tolist() for x in pfp.Corpus(docs).equal_strings(20))
    strings = {}
    at = 0
    for d in docs:
        for i in range(len(d) - 19):
            strings[at + i] = d[i : i + 20]
        at += len(d)
    assert sorted(place) == sorted(strings)
    assert [strings[p] for p in place] == sorted(strings.values())
    assert len(set(zip(number, map(strings.get, place)))) == len(set(number)) == len(set(strings.values()))


def test_phrases_are_prefix_free_and_make_up_the_documents():
    docs = documents(3)
    c = pfp.Corpus(docs)
    inner = [p for p, goes_on in c.phrases if goes_on]
    assert len(inner) > 5 and not any(a != b and b.startswith(a) for a in inner for b in inner)
    back, out = [], b""
    for k, final in zip(c.phrase.tolist(), c.final.tolist()):
        p = c.phrases[k][0]
        out += p if final else p[: -pfp.WINDOW]
        if final:
            back.append(out)
            out = b""
    assert back == [d for d in docs if d]
