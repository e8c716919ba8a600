"""Context-tree weighting against a direct recursion over all contexts."""

import functools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from symgraph.llm import ctw


def serial(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


def whole(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode() + b"\xff"


def brute(rows, depth):
    """The probability of a bit is that of training and bit together over that of training, both by the recursion."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    streams = [(i, whole(t)) for i, t in rows]

    def steps(raw):
        padded = b"\xff" * depth + raw
        for p in range(depth, len(padded)):
            context = padded[p - depth : p][::-1]
            for k in range(8):
                yield context, (k, padded[p] >> (8 - k)), padded[p] >> (7 - k) & 1

    for i, raw in streams:
        if not held(i):
            for context, node, bit in steps(raw):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
                    if d:
                        kids[context[: d - 1], node].add(context[:d])
    half = lambda own, deep: max(own, deep) + math.log((math.exp(own - max(own, deep)) + math.exp(deep - max(own, deep))) / 2)

    @functools.cache
    def weighted(context, node):
        own = log_kt(*counts[context, node]) if (context, node) in counts else 0.0
        return own if len(context) == depth else half(own, sum(weighted(c, node) for c in kids.get((context, node), ())))

    def with_bit(context, node, bit, d=0):
        a, b = counts[context[:d], node] if (context[:d], node) in counts else (0, 0)
        own = log_kt(a + (bit == 0), b + (bit == 1))
        if d == depth:
            return own
        others = sum(weighted(c, node) for c in kids.get((context[:d], node), ()) if c != context[: d + 1])
        return half(own, others + with_bit(context, node, bit, d + 1))

    predict = functools.cache(lambda context, node, bit: with_bit(context, node, bit) - weighted(b"", node))

    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update([*serial(t), "\n"])
    n, v = sum(train.values()), len(train)
    out = {}
    for (i, t), (_, raw) in zip(rows, streams):
        score = 0.0
        for context, node, bit in steps(raw):
            score += predict(context, node, bit) / math.log(10)
        words = [*serial(t), "\n"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out[i, t] = (held(i), len(words), sum(train[w] > 0 for w in words), n, base, score)
    return out


def check(spark, rows, part_bytes, roots=None):
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, score string, held_out string")
    want = brute(rows, ctw.DEPTH)
    got = ctw.score(df, part_bytes=part_bytes, roots=roots).collect()
    order = lambda x: (str(x[0]), x[1][1:])
    mine = sorted(((r[0], tuple(r)[1:7]) for r in got), key=order)
    theirs = sorted(((i, want[i, t]) for i, t in rows), key=order)
    assert len(mine) == len(theirs)
    for (a, x), (b, y) in zip(mine, theirs):
        assert a == b and x[:4] == y[:4] and x[4] == pytest.approx(y[4], rel=1e-9) and x[5] == pytest.approx(y[5], rel=1e-6)


def some_rows():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["The ", "cat", "\n", "sat  ", "ça ", "\t", "ab" * rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 25)))) for i in range(45)]
    return rows + [(100, None), (101, ""), (102, "\n \t"), (None, "the cat"), (103, "x" * 300), rows[2], rows[2]]


def split_roots(rows, share):
    """Some contexts of two bytes, some longer ones of these, and so on, as heavy ones."""
    rng, out = random.Random(2), {}
    keys = ctw.keys_of([whole(t) for _, t in rows])[0]
    for d in range(ctw.ROOT, ctw.DEPTH):
        found = [c for c in sorted(set(ctw.context_of(keys, d).tolist())) if (d == ctw.ROOT or c >> 8 in out[d - 1]) and rng.random() < share]
        if found:
            out[d] = found
        else:
            break
    return ctw.Roots({d: np.array(c, np.uint64) for d, c in out.items()})


@pytest.mark.parametrize("part_bytes, share", [(1 << 24, 0), (400, 0), (400, 0.3), (700, 0.9)])
def test_scores(spark, part_bytes, share):
    rows = some_rows()
    check(spark, rows, part_bytes, split_roots(rows, share))


def test_scores_with_estimated_roots(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {2, 3} <= set(ctw.heavy(df, "doc_id", "text", 12, 1).heavy)
    check(spark, rows, 300)


def test_white_space_counts(spark):
    rows = [(i, f"a b\n\n  {i}") for i in range(40)] + [(50, "a b"), (51, "a\n\n  b")]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] != got[51]


def test_a_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(2 * ctw.CHUNK))
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame([(1, long), (2, long[:1000]), (3, "q")], "doc_id long, text string"), part_bytes=1 << 19).collect()}
    assert 3.2 < got[1]["bits_per_byte"] < 3.6 and got[1]["n_tokens"] == len(long.split()) + 1


def test_all_held_out_and_empty(spark):
    alone = [i for i in range(200) if held(i)][:3]
    check(spark, [(i, "a b") for i in alone], 1 << 24)
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ctw.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
