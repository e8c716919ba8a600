"""Vector codes against plain integer Lloyd rounds."""

import hashlib

import numpy as np
import pytest

from symgraph.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, n int, salt string, code string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", "y", 2) for i, v, label in rows], SCHEMA)


def plain(rows):
    """(id, code, error, label_error, digest) of every kept row, with loops over all entries."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    key = lambda r: (r[0] is None, r[0] or 0, [np.float32(x) for x in r[1]])
    dim = len(min(good, key=key)[1])
    good = sorted((r for r in good if len(r[1]) == dim), key=key)
    cut = lambda v: [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v[q * dim // 4 : (q + 1) * dim // 4]] for q in range(4)]
    parts = [cut(r[1]) for r in good]
    books = [[p[q] for p in parts[:256]] for q in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, q: min(range(len(books[q])), key=lambda e: (far(p[q], books[q][e]), e))
    for _ in range(4):
        of = [[near(p, q) for q in range(4)] for p in parts]
        new = []
        for q in range(4):
            book = list(books[q])
            for e in range(len(book)):
                mine = [p[q] for p, o in zip(parts, of) if o[q] == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)] if mine else book[e]
            new.append(book)
        books = new
    of = [[near(p, q) for q in range(4)] for p in parts]
    error = [sum(far(p[q], books[q][o[q]]) for q in range(4)) for p, o in zip(parts, of)]
    by = {}
    for r, e in zip(good, error):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{x:02x}" for x in o), e, by[r[2]], digest)) for r, o, e in zip(good, of, error))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, spread, dim)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_equals_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vectors(1, 330, 8)
    assert found(codes.encode(frame(spark, rows).repartition(3))) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = vectors(2, 60, 8, 0.002)  # few distinct integers: most distances tie
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[4][1], None), (70, None, 1), (71, [None] * 8, 1), (72, [float("nan")] + [0.0] * 7, 2), (73, [float("inf")] * 8, 2), (74, [], 2), (75, [1.0] * 4, 2)]
    rows += [(100 + i, rows[0][1], 9) for i in range(300)]  # one vector many times over
    assert found(codes.encode(frame(spark, rows))) == plain(rows)


def test_few_and_none(spark):
    rows = vectors(3, 3, 4)
    assert found(codes.encode(frame(spark, rows))) == plain(rows)
    none = codes.encode(frame(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.encode(frame(spark, [])).count() == 0
    assert found(codes.encode(frame(spark, [(1, [], 1), (2, [], None)]))) == plain([(1, [], 1), (2, [], None)])
    with pytest.raises(ValueError, match="equal parts"):
        codes.encode(frame(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(ValueError, match="too large"):
        codes.encode(frame(spark, [(1, [1e30] * 8, 1)]))


@pytest.mark.parametrize("n, dim, k, m", [(1, 4, 3, 5), (40, 4, 9, 3), (3000, 16, 256, 300), (2000, 3, 256, 2), (2000, 16, 200, 1), (700, 4, 50, 1 << 25), (50, 0, 3, 1)])
def test_subtrees_equal_all_points(n, dim, k, m):
    rng = np.random.default_rng(n)
    points, book = rng.integers(-m, m + 1, (n, dim)), rng.integers(-m, m + 1, (k, dim))
    tree = codes._unpack(codes._pack(codes.grow(points)))
    sums, counts, owner = codes.descend(tree, book, each=True)
    want = ((points[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = np.empty(n, int)
    got[tree["order"]] = owner
    total = np.zeros_like(book)
    np.add.at(total, want, points)
    assert (got == want).all() and (sums == total).all() and (counts == np.bincount(want, minlength=k)).all()


def test_boxes_rule_entries_out():
    """Far clusters: nearly all points are given to entries by whole subtrees."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-(1 << 12), 1 << 12, (64, 2))
    points = centres[rng.integers(0, 64, 8000)] + rng.integers(-8, 9, (8000, 2))
    seen = []
    plain_nearest = codes.Exact.nearest
    codes.Exact.nearest = lambda self, node, entry, s, e: seen.append(len(np.unique(node))) or plain_nearest(self, node, entry, s, e)
    try:
        codes.descend(codes.grow(points), centres, each=False)
    finally:
        codes.Exact.nearest = plain_nearest
    assert sum(seen) < 100  # of 256 leaves or more
