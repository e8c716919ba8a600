"""Line dedup and repeated byte strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from symgraph.llm import line_dedup, repeats

SCHEMA = "doc_id long, text string, _part string, source string"


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        raw, own = (t or "").encode(), 2**63 - 1 if i is None else i
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            first[s] = min(first.get(s, own), own)
    out = []
    for i, t in rows:
        raw, own = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_lines(rows):
    first, keyed = {}, []
    for i, t in rows:
        own = 2**63 - 1 if i is None else i
        lines = (t or "").split("\n")
        used = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        text = [lines[k].strip(" \t\n\r\x0b\x0c") for k in used]
        found = [tuple(text[k : k + 3]) for k in range(len(text) - 2)]
        for k, w in enumerate(found):
            first[w] = min(first.get(w, (own, k)), (own, k))
        keyed.append((i, own, t, lines, used, found))
    out = []
    for i, own, t, lines, used, found in keyed:
        gone = {x for k, w in enumerate(found) if (own, k) != first[w] for x in used[k : k + 3]}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines) if t else 0, len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "é", "qu", "x1", "ß", "o"]) for _ in range(rng.randrange(1, 5)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 14)))
    shared = [line() for _ in range(25)]
    rows = []
    for i in range(120):
        own = [rng.choice(shared) if rng.random() < 0.3 else line() for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.4:
            at = rng.randrange(0, 20)
            own[rng.randrange(0, len(own) + 1) : 0] = shared[at : at + rng.randrange(1, 6)]
        rows.append((i, "\n".join(own)))
    rows += [(200 + i, rows[rng.randrange(0, 50)][1]) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "ab" * 700), (303, "ab" * 500), (304, "x" * 49), (305, "\n\n \n"), (306, "a\na\na\na\na"), (None, rows[3][1]), (None, rows[5][1])]
    rows += [rows[7], rows[7], (7, rows[8][1]), (307, "\n" + rows[9][1] + " \n\n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part_bytes, hot", [(1 << 24, 1 << 16), (4000, 1 << 16), (4000, 2), (4000, 0)])
def test_repeats(spark, part_bytes, hot):
    rows = cases()
    df = spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, repeats.dedup(df, part_bytes=part_bytes, hot=hot).collect()), key=str)
    assert got == brute_repeats(rows)


def test_adversarial_texts(spark):
    """Periodic texts, and one on which polynomial hashes modulo a power of two collide."""
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, "\0" * 3000), (2, "x" + "\0" * 2000), (3, morse[:2048]), (4, other[:2048]), (5, "".join(morse[i : i + 64] + "-" for i in range(0, 4096, 64))), (6, "abc" * 900 + morse[100:400]), (7, "bca" * 700)]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    for part_bytes, hot in ((1 << 24, repeats.HOT), (1500, 3)):
        assert sorted(map(tuple, repeats.dedup(df, part_bytes=part_bytes, hot=hot).collect()), key=str) == brute_repeats(rows)


def test_counts_of_runs_in_a_byte():
    count = np.array([0, 1, 2, 219, 220, 221, 439, 440, 441, 19_999, 65_536, 10**9])
    code = repeats.in_a_byte(count)
    found = repeats.from_a_byte(code)
    assert code.dtype == np.uint8 and (found >= count).all() and (found < 2 * np.maximum(count, 1)).all()
    assert (found == count)[:5].all() and found[7] == 440


def test_a_key_of_very_many_runs_of_one_part_is_hot(spark, monkeypatch):
    """One gram with the smallest hash of all in 20,000 different surroundings: one key, announced by one part."""
    rng = random.Random(8)
    letters = "abcdefghijklmnop"
    raw = "".join(rng.choice(letters) for _ in range(200_000)).encode()
    grams = repeats.Slab([0], [0], [raw]).grams()
    gram = raw[int(grams.argmin()) :][: repeats.GRAM].decode()
    around = lambda: "".join(rng.choice(letters) for _ in range(34))
    rows = [(i, around() + gram + around()) for i in range(20_000)]
    rows += [(30_000 + i, rows[i][1][5:70]) for i in range(0, 200)]
    parse = repeats.Parse([t.encode() for _, t in rows], np.array([i for i, _ in rows]))
    parse.kept = np.arange(len(parse.key))
    key, count = np.unique(repeats.address(parse.run_key[parse.kept_runs()[0]], 1), return_counts=True)
    assert repeats.from_a_byte(repeats.in_a_byte(count)).max() >= 19_000

    told, plain = [], repeats._shared

    def watched(n, hot):
        fn = plain(n, hot)
        assert n == 1

        class Box:
            def put(self, to, keys, flags):
                told.append((len(keys), int(flags.sum())))

        box = Box()
        payload = [(0, repeats.low(key).tobytes(), repeats.in_a_byte(count).tobytes(), b"")]
        fn(0, payload, box)
        return plain(n, hot)

    monkeypatch.setattr(repeats, "_shared", watched)
    df = spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, repeats.dedup(df, part_bytes=1 << 30, hot=10_000).collect()), key=str)
    assert got == brute_repeats(rows)
    assert told and told[0][1] == 1  # the one key is hot, the others aren't


def test_repeats_of_a_text_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(3 * repeats.CHUNK // 2))
    cut = long[repeats.CHUNK - 100 : repeats.CHUNK + 300]
    df = spark.createDataFrame([(1, cut, "", ""), (2, long, "", ""), (3, long[: repeats.CHUNK + 10], "", "")], SCHEMA)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.dedup(df).collect()}
    assert got == {1: (0, 0), 2: (400, 1), 3: (repeats.CHUNK + 10, 1)}


@pytest.mark.parametrize("part_bytes", [1 << 24, 4000])
def test_lines(spark, part_bytes):
    rows = cases()
    df = spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, line_dedup.dedup(df, part_bytes=part_bytes).collect()), key=str)
    assert [(None if i == 2**63 - 1 else i, *x) for i, *x in got] == brute_lines(rows)


def test_lines_keep_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "p", "s"), (2, "a\nb\nc", "q", "t"), (3, "z\na\nb\nc\ny", "r", None), (4, "", "e", None), (5, None, "n", None)], SCHEMA)
    got = sorted(map(tuple, line_dedup.without_repeats(df.select("source", "text", "doc_id")).collect()), key=lambda r: r[2])
    assert got == [("s", "a\nb\nc", 1), (None, "z\ny", 3), (None, "", 4), (None, None, 5)]


@pytest.mark.parametrize("part_bytes", [1 << 24, 40])
@pytest.mark.parametrize("own", [None, 7])
def test_one_of_several_texts_with_equal_ids_is_first(spark, part_bytes, own):
    """A common header at the same place stays in one of the different texts, and in all copies of that one."""
    texts = [f"a\nb\nc\n{x}" for x in ("one", "two", "three", "four")]
    df = spark.createDataFrame([(own, t, "", "") for t in [*texts, *texts]], SCHEMA)
    got = sorted(r["text"] for r in line_dedup.without_repeats(df, part_bytes=part_bytes).collect())
    assert len(got) == 8 and [t for t in got if "\n" in t] == [max(got, key=len)] * 2
    assert sorted(t.split("\n")[-1] for t in got) == sorted(["one", "two", "three", "four"] * 2)
    assert sorted(r["n_removed"] for r in line_dedup.dedup(df, part_bytes=part_bytes).collect()) == [0, 0, 3, 3, 3, 3, 3, 3]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.dedup(df).count() == 0
    assert line_dedup.dedup(df).count() == 0
    assert line_dedup.without_repeats(df).count() == 0


def test_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats.dedup(docs, part_bytes=100_000).collect()), key=str) == brute_repeats(rows)
    assert sorted(map(tuple, line_dedup.dedup(docs, part_bytes=100_000).collect()), key=str) == brute_lines(rows)
