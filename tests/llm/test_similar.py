"""Similarity of shingle sets and the pipeline's near_dedup stage, against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from symgraph.llm import similar

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Ids that stand for their component; rows: (id, text) with ids."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or words[i] == words[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        least[find(i)] = min(a, least.get(find(i), a))
    return sorted({a for i, (a, _) in enumerate(rows) if least[find(i)] == a})


def variants():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.choice((20, 200, 400)))] for _ in range(8)]
    rows = []
    for i in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 7)):
            text[rng.randrange(len(text))] = word()
        rows.append((i + 10, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One Two"), (504, "one  two"), (505, "one three")]
    return rows + [rows[3], (10, "another text of this id that has words"), (5, "another text of this id that has Words")]


@pytest.mark.parametrize("tile, most", [(2048, 4), (7, 1000), (7, 1), (30, 1)])
def test_against_all_pairs(spark, monkeypatch, tile, most):
    """In whole blocks, in tiles, and as crowds: by hubs and bands, with and without tiles."""
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "MOST_TILES", most)
    rows = variants()
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id long, text string")
    got = [r[0] for r in similar.representatives(df).collect()]
    assert got.count(None) == 2 and sorted(i for i in got if i is not None) == brute_kept(rows)


def test_dissimilar_texts_of_a_template_share_few_bands():
    """Of 2,000 texts at a similarity of 0.31 one has fewer than 20 partners (11 in the mean over all templates, with a
    heavy tail: a band whose smallest hashes are all the template's and all very small is shared by many; so the median
    over templates counts here).  Of pairs at 0.8, all share a band."""
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    partners = []
    for _ in range(9):
        template = fresh(95)
        found = [set(similar.bands(np.concatenate([template, fresh(105)])).tolist()) for _ in range(500)]
        holders = {}
        for i, row in enumerate(found):
            for b in row:
                holders.setdefault(b, set()).add(i)
        partners.append(np.mean([len(set().union(*(holders[b] for b in row))) - 1 for row in found]) * 2000 / 500)
    assert 0 < np.median(partners) < 20
    missed = 0
    for n in (9, 45, 90, 900) * 100:
        a = fresh(n)
        b = np.concatenate([a[n // 9 :], fresh(n // 9)])  # 8/10
        missed += not (similar.bands(np.unique(a)) == similar.bands(np.unique(b))).any()
    assert missed == 0


def test_similar_texts_are_within_the_radius():
    """Of pairs at a similarity of 0.8 and more, at all sizes, none is beyond the radius, most others are."""
    rng, near, far = np.random.default_rng(5), [], []
    for n in [5, 6, 9, 10, 20, 45, 90, 450, 3000] * 60:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = n // 9  # taken out of one and put into the other: (n - gone) / (n + gone) = 0.8
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]) if gone else a[1:]
        bits = lambda x, y: int(np.bitwise_count(similar.fingerprint(x) ^ similar.fingerprint(y)).sum())
        near.append(bits(a, b))
        far.append(bits(a, rng.integers(0, 1 << 63, n, dtype=np.uint64)))
    assert max(near) <= similar.RADIUS and np.mean(np.array(far) <= similar.RADIUS) < 0.05


def test_stage_links_pairs_that_are_over_four_bits_apart(spark):
    """Documents 1 and 177: similarity 0.83, fingerprints 9 bits apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = corpus_pipeline.line_dedup_stage(spark, corpus_pipeline.quality_stage(spark, docs, SF), SF).cache()
    got = sorted(r[0] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    assert got == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert 1 in got and 177 not in got
