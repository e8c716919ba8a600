"""Fingerprints and their components, against brute force."""

import random

import numpy as np
import xxhash

from symgraph.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (id, fp)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(fps):
        for j, (b, y) in enumerate(fps[:i]):
            if a == b or (x ^ y).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(fps):
        least[find(i)] = min(a, least.get(find(i), a))
    return [least[find(i)] for i in range(len(fps))]


def test_close_pairs():
    rng = random.Random(1)
    for n in (1, 63, 64, 65, 300):
        base = [rng.getrandbits(64) for _ in range(8)]
        fps = []
        for _ in range(n):
            x = rng.choice(base)
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
        a = np.array(fps, np.uint64)
        pairs = list(simhash.links(a, None))
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in pairs) and len(pairs) < n
        ids = list(range(n))
        got = brute_components([(i, fps[i]) for i in ids])
        root = ids[:]
        for i, j in pairs:
            x, y = root[i], root[j]
            root = [min(x, y) if r in (x, y) else r for r in root]
        assert root == got
        cut = n // 2
        cross = list(simhash.links(a[:cut], a[cut:])) if cut else []
        want = {(i, j) for i in range(cut) for j in range(n - cut) if (fps[i] ^ fps[cut + j]).bit_count() <= 4}
        assert set(cross) <= want and {i for i, _ in cross} == {i for i, _ in want} and {j for _, j in cross} == {j for _, j in want}


def test_masks_find_every_pair():
    for m in (5, 6, 7):
        masks = simhash.masks(m)
        rng = random.Random(m)
        for _ in range(200):
            flips = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(flips & x == 0 for x in masks)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in simhash.cluster(df).collect())
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    known = [x for x in fps if x[0] is not None]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(known, brute_components(known))] + [(-1, f"{fp:016x}", -1) for i, fp in fps if i is None]
    assert got == sorted(want)


def test_components(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    base = [[word() for _ in range(160)] for _ in range(6)]
    rows = []
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = word()
        rows.append((i + 10, " ".join(text), "p", "q"))
    rows += [(500, None, "", ""), (501, "", "", ""), (502, " \n\t", "", ""), (503, "One Two", "", ""), (504, "one  two", "", ""), (None, rows[0][1], "", ""), (None, None, "", "")]
    rows += [rows[3], (10, "another text of this id that has words", "", ""), (5, "another text of this id that has Words", "", "")]
    check(spark, rows)
    monkeypatch.setattr(simhash, "TILE", 16)  # keys in many tiles
    check(spark, rows)


def test_wide_radii():
    rng = random.Random(7)
    fps = np.array([[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(70)], np.uint64)
    fps[10:20] = fps[0] ^ np.array([[sum(1 << rng.randrange(64) for _ in range(3)), 1 << k] for k in range(10)], np.uint64)
    block = np.concatenate([simhash.planes(fps[:, 0]), simhash.planes(fps[:, 1])])
    want = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2)
    for radius in (0, 1, 4, 5, 48, 63, 64, 70, 127):
        near = simhash.close(block, fps, np.zeros((70, 2), np.uint64), radius)
        got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :70].astype(bool)
        assert (got == (want <= radius)).all()


def test_hot_keys_go_through_finer_tables(spark):
    """Many fingerprints that agree on a whole block, and close pairs among them."""
    rng = random.Random(3)
    fps = {rng.getrandbits(48) << 16 for _ in range(150)}
    fps |= {x ^ sum(1 << k for k in rng.sample(range(16, 64), 4)) for x in list(fps)[:40]}
    rows = [(simhash._signed(x), i) for i, x in enumerate(sorted(fps))]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, _id long"), len(rows), tile=8, copies=3, m=5).collect()
    at = {i: x % (1 << 64) for x, i in rows}
    assert all((at[r["u"]] ^ at[r["v"]]).bit_count() <= 4 for r in links)
    label = {i: i for i in at}
    for r in links:
        a, b = label[r["u"]], label[r["v"]]
        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert [label[i] for i in sorted(at)] == brute_components([(i, at[i]) for i in sorted(at)])


def test_empty(spark):
    assert simhash.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives(spark):
    rows = [(3, "a b c", "x"), (1, "A b  c", "y"), (2, "quite another text of some words", "z"), (None, "a b c", "w")]
    for again in ([], [rows[1]], [rows[1], rows[2], rows[0]]):  # of a repeated row one stays
        got = simhash.representatives(spark.createDataFrame(rows + again, "doc_id long, text string, _id string"))
        assert got.columns == ["doc_id", "text", "_id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r[0], r[1], "", "") for r in docs.select("doc_id", "text").collect()])
