"""SimHash near-duplicates at a wide radius: the similarity of shingle sets in place of a few differing bits.

Rule.  Words as in `simhash`; a text is the set of its runs of SIZE words (one run if there are fewer words).
Two texts are linked if the sets' Jaccard similarity is SIMILARITY or more, or if their words are equal (so
texts without a word are copies of each other).  Components of the links count, by the smallest id.

Fingerprints.  At a similarity of 0.8 a bit of two SimHashes differs with a chance of 0.15 (0.19 for sets of a few
shingles), so 64 bits differ in 10 on average and masks that two fingerprints must agree on, as `simhash` has them, do
not exist.  Fingerprints have 128 bits here, compared bit-sliced as there, at a radius of RADIUS: a similar pair is
beyond it with a chance of less than 1e-7, two texts that have nothing in common are within it in 3 of 1000 cases.
What is within it is verified on the whole sets.

Blocks.  What is compared with what is decided by smallest shingles: texts of equal words collapse first (128-bit
hash, smallest id kept).  BANDS bands of ROWS smallest hashes (32 bits) each are hashed; whoever shares a band with
another is tied to the smallest id of the band, its hub, and the components of these ties are the blocks.  A pair at
similarity s shares no band with a chance of (1 - s^ROWS)^BANDS: 8e-6 at 0.8, 1e-9 at 0.85; one at 0.3 shares one with
a chance of 4e-3.

Comparison.  All texts of a block meet once.  A block of more than TILE texts or TILE_SHINGLES shingles is cut into
tiles, and each pair of tiles is a group of its own.  Tiles give a spanning forest of their links.  Comparison stops
once a tile hangs together.

Crowds.  Ties of texts that aren't similar chain up, so blocks may grow with the corpus.  A block of more than
MOST_TILES tiles is not compared as a whole.  First each text meets the hubs of its bands, which settles large groups
of near copies in linear work; then the bands whose texts don't hang together yet are compared, each for itself (in
tiles, if need be).  Nobody meets a text with which it shares no band, and no text is sent more often than it has
bands, times the tiles of the band.

Of rows with equal ids and different texts, which are one node, one stays: that with the smallest hash of its text.
Rows with a null id link nothing and stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, splitmix
from .graph import components
from .simhash import close, one_of_each, planes, shingles

SIZE = 5
SIMILARITY = 0.8
BANDS = 64
ROWS = 8
#: Differing bits of 128 up to which a pair is verified.
RADIUS = 48
_QUERIES = 64
TILE = 2048
TILE_SHINGLES = 1 << 20
#: Tiles of a block up to which all of its texts meet; at least 1.
MOST_TILES = 4
_PLACES = splitmix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(32))
_XOR, _TIMES = _PLACES.astype(np.uint32), (_PLACES >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MIX = np.uint32(0x2C1B3C6D)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array(shingles(text, size), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """Hashes of the bands of a shingle set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint32(0))
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(found), 128):
        part = short[at : at + 128, None] ^ _XOR
        part *= _TIMES
        part ^= part >> np.uint32(15)
        part *= _MIX
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = splitmix(out + least.reshape(BANDS, ROWS)[:, k].astype(np.uint64))
    return out


def _described(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, key of the words, number of shingles, bands) of every row with an id."""

    def fn(cols: dict) -> dict:
        key, n, band = [], [], []
        for t in cols["_text"]:
            found = shingle_set(t, size)
            key.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())))
            n.append(len(found))
            band.append(bands(found).view(np.int64).tolist() if len(found) else [])
        return {"_id": cols["_id"], "key": key, "n": n, "band": band}

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    return map_rows(rows, fn, "_id long, key binary, n long, band array<long>", 128)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Two words: a bit is set if over half of the shingles' 128-bit hashes have it."""
    total = np.zeros(128, np.int64)
    for at in range(0, len(found), 1 << 14):
        part = found[at : at + (1 << 14)]
        both = np.stack([part, splitmix(part + np.uint64(1))], axis=1).astype("<u8")
        total += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(found), bitorder="little").view("<u8")


def links(sets: list[np.ndarray], left: np.ndarray | None, similarity: float, known: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs, as places; left: flags, if only pairs of a flagged with another set count;
    known: sets with equal numbers hang together already."""
    n = np.array([len(s) for s in sets])
    prints = np.stack([fingerprint(s) for s in sets])
    block = np.concatenate([planes(prints[:, 0]), planes(prints[:, 1])])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holders = np.repeat(np.arange(len(sets)), n)[order]
    starts = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
    ends, label = np.cumsum(n), np.unique(known, return_inverse=True)[1]
    groups = int(label.max()) + 1
    lanes = np.arange(block.shape[1] * 64)
    unasked = (lanes >= len(sets)) | (np.append(left, np.zeros(len(lanes) - len(left), bool)) if left is not None else False)
    queries = np.arange(len(sets)) if left is None else np.flatnonzero(left)
    for at in range(0, len(queries), _QUERIES):
        part = queries[at : at + _QUERIES]
        dead = np.repeat(unasked[None, :], len(part), axis=0) if left is not None else unasked[None, :] | (lanes[None, :] <= part[:, None])
        near = close(block, prints[part], np.packbits(dead, axis=1, bitorder="little").view(np.uint64), RADIUS)
        if near is None:
            continue
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            if groups == 1:
                return
            i = int(part[k])
            some = np.flatnonzero(np.unpackbits(near[k].view(np.uint8), bitorder="little"))
            some = some[label[some] != label[i]]
            own = token[ends[i] - n[i] : ends[i]]
            if not len(some) or not len(own):
                continue
            shared = np.zeros(len(sets), np.int64)
            for t in range(0, len(own), 256):
                shared += np.bincount(np.concatenate([holders[starts[x] : starts[x + 1]] for x in own[t : t + 256].tolist()]), minlength=len(sets))
            for j in some[shared[some] / (n[i] + n[some] - shared[some]) >= similarity].tolist():
                if label[j] != label[i]:
                    yield i, j
                    label[label == label[j]] = label[i]
                    groups -= 1


def _compare(size: int, similarity: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def forest(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (_, one, two), own = rows[0][0], np.array([r[2] for r in rows], np.int64)
        left = None if one == two else np.array([r[1] == one for r in rows])
        known = np.array([r[3] for r in rows], np.int64)
        pairs = list(links([r[4] for r in rows], left, similarity, known)) if len(rows) > 1 else []
        if pairs:
            i, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for *r, t in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("split", "one", "two", "tile", "_id", "known", "_text")]):
                    yield (*r, shingle_set(t, size))  # no text is held for longer

        for key, group in itertools.groupby(rows(), key=lambda r: r[:3]):
            yield from forest([(key, *r[3:]) for r in group])

    return run


def _tiles(c: str, n: str):
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(c) / TILE, F.col(n) / TILE_SHINGLES))).cast("int")


def _dealt(members: DataFrame) -> DataFrame:
    """(split, one, two, tile, _id, known): every pair of tiles of a group is a group, from (split, tiles, _id, known)."""
    dealt = members.withColumn("tile", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("tiles")).cast("int"))
    both = dealt.select("split", "tile", "_id", "known", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    return both.select("split", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "_id", "known")


def _pairs(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """Links (u, v) between the ids of distinct texts (_id, n, band)."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def met(groups: DataFrame) -> DataFrame:
        rows = texts.join(groups, "_id").repartition("split", "one", "two").sortWithinPartitions("split", "one", "two")
        return rows.mapInArrow(_compare(size, similarity), "u long, v long")

    spread = distinct.select("_id", F.explode("band").alias("b"))
    least = spread.groupBy("b").agg(F.min("_id").alias("u"), F.max("_id").alias("most")).where("u <> most").select("b", "u")
    tied = components(spread.join(least, "b").select("u", F.col("_id").alias("v")))
    group = tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
    sizes = distinct.join(group, distinct["_id"] == group["node"]).groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    large = checkpoint(sizes.select("component", _tiles("c", "n").alias("tiles")).where("tiles > 1"))
    members = group.join(large, "component", "left").select(F.col("node").alias("_id"), F.col("component").alias("split"), F.coalesce("tiles", F.lit(1)).alias("tiles"), F.col("node").alias("known"))
    found = met(_dealt(members.where(F.col("tiles") <= MOST_TILES)))
    if large.where(F.col("tiles") > MOST_TILES).isEmpty():
        return found
    crowd = members.where(F.col("tiles") > MOST_TILES).select("_id").join(distinct.select("_id", "n", "band"), "_id")
    shared = checkpoint(crowd.select("_id", "n", F.explode("band").alias("b")).join(least, "b"))
    hubs = _met_hubs(shared, met)
    settled = components(hubs)
    known = shared.join(settled, shared["_id"] == settled["node"], "left").select("b", "_id", "n", F.coalesce("component", "_id").alias("known"))
    still = known.groupBy("b").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.min("known").alias("x"), F.max("known").alias("y")).where("x <> y")
    rest = known.drop("n").join(still.select("b", _tiles("c", "n").alias("tiles")), "b").select(F.col("b").alias("split"), "tiles", "_id", "known")
    return found.unionByName(hubs).unionByName(met(_dealt(rest)))


def _met_hubs(shared: DataFrame, met) -> DataFrame:
    """Links between hubs and the texts of their bands, from (b, u, _id, n): a hub is sent to each slice of its texts."""
    stars = shared.where("_id <> u").select("u", "_id", "n").distinct()
    slices = stars.groupBy("u").agg(F.count("*").alias("c"), F.sum("n").alias("n")).select("u", _tiles("c", "n").alias("tiles"))
    slice_ = F.pmod(F.xxhash64("_id", F.lit(1)), F.col("tiles")).cast("int")
    rows = stars.drop("n").join(slices, "u").select(F.col("u").alias("split"), F.lit(-1).alias("one"), slice_.alias("two"), slice_.alias("tile"), "_id", F.col("_id").alias("known"))
    own = slices.select(F.col("u").alias("split"), F.lit(-1).alias("one"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("two"), F.lit(-1).alias("tile"), F.col("u").alias("_id"), F.col("u").alias("known"))
    return checkpoint(met(rows.unionByName(own)))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each component (its smallest id), and the rows without an id, with all columns."""
    rows = checkpoint(_described(docs, id_col, text_col, size))
    distinct = rows.groupBy("key").agg(F.min(F.struct("_id", "n", "band")).alias("x")).select("key", "x.*")
    copies = rows.select("key", F.col("_id").alias("v")).distinct().join(distinct.select("key", F.col("_id").alias("u")), "key").where("u <> v").select("u", "v")
    gone = components(_pairs(docs, distinct, id_col, text_col, size, similarity).unionByName(copies)).select(F.col("node").alias("_id")).distinct()
    return one_of_each(docs, gone, rows.select("_id"), id_col, text_col)
