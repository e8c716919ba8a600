"""SimHash near-duplicates: 64-bit fingerprints, linked at RADIUS or fewer differing bits.

Fingerprints.  Words are split on ASCII white space after lower-casing A-Z; each run of SHINGLE words,
joined by spaces, is hashed by XXH64 (seed 42); a bit of the fingerprint is set if over half of the hashes
have it.  Texts of fewer words are one shingle; texts without a word have fingerprint 0 and are linked like
any other.

Candidates.  Equal fingerprints collapse first (smallest id kept).  The 64 bits are cut into m blocks; two
fingerprints that differ in at most RADIUS bits agree on m - RADIUS blocks at least, so a table for each
choice of these finds every pair.  m is the smallest from RADIUS + 1 on for which a table's keys would hold
no more than TILE fingerprints each on average; whatever m, the links are the same.

Comparison.  Within a key, fingerprints are compared bit-sliced: the bit planes of up to TILE fingerprints
lie in machine words, a query's planes are xored onto them, and carry-save adders count the differing bits of
64 pairs per word.  A block of queries is given up once all its counters have passed the radius.  A key with
more than TILE fingerprints is cut into tiles, and each pair of tiles is a group of its own, so that no task
gets all of it.  Of a key with more than COPIES tiles the fingerprints are taken through the tables of MOST_BLOCKS
blocks instead, whose keys have three times as many bits, so that what is sent grows with their number and not with
its square.  A group gives a spanning forest of its links, never all pairs.

Components are found by alternating stars (see `graph`); component_id is the smallest id reachable.

Rows with a null id get their fingerprint and no component; they link nothing.  Rows with equal ids and
different texts link their fingerprints' components under that id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows
from .graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 2048
MOST_BLOCKS = 12
#: Tiles of a key up to which each of its fingerprints is sent to all of them: as many as there are tables at most.
COPIES = 495
_QUERIES = 64
_ONE = np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of size words; of all words where there are fewer; nothing where there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    n = len(words)
    if n <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip((ends - sizes)[: n - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: str | None) -> int:
    hashes = shingles(text)
    if len(hashes) < 2:
        return hashes[0] if hashes else 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp as signed long) of every row."""

    def fn(cols: dict) -> dict:
        found = np.array([fingerprint(t) for t in cols["_text"]], np.uint64)
        return {"_id": cols["_id"], "fp": pa.array(found.view(np.int64))}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), fn, "_id long, fp long", 128)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j of word w in row k is bit k of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close(block: np.ndarray, queries: np.ndarray, dead: np.ndarray, radius: int = RADIUS) -> np.ndarray | None:
    """Which pairs (query, lane) differ in `radius` or fewer bits, as words; None once all are beyond it.

    block: bit planes, 64 for each word of a fingerprint; queries: fingerprints, of a word or a row of words each.
    dead: words of pairs that aren't asked for.  Pairs are counted in bit-sliced counters by carry-save addition, two
    planes at a time; `over` keeps what passed the largest count.
    """
    words = queries.reshape(len(queries), -1)
    over = dead.copy()
    count = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]

    def beyond() -> np.ndarray:
        more, same = over.copy(), ~np.uint64(0)
        for i in reversed(range(len(count))):
            if radius >> i & 1:
                same = same & count[i]
            else:
                more |= same & count[i]
                same = same & ~count[i]
        return more

    plane = lambda k: block[k] ^ (np.uint64(0) - ((words[:, k // 64] >> np.uint64(k % 64)) & _ONE))[:, None]
    for k in range(0, len(block), 2):
        a, b = plane(k), plane(k + 1)
        half = a ^ b
        carry = (a & b) | (half & count[0])
        count[0] ^= half
        for c in count[1:]:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if k % 8 == 6 and (beyond() == ~np.uint64(0)).all():
            return None
    return ~beyond()


def links(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the close pairs within a (b None) or between a and b, as places."""
    other = a if b is None else b
    block = planes(other)
    label = np.arange(len(other))
    lanes = np.packbits(np.arange(block.shape[1] * 64) >= len(other), bitorder="little").view(np.uint64)
    for at in range(0, len(a), _QUERIES):
        part = a[at : at + _QUERIES]
        dead = np.repeat(lanes[None, :], len(part), axis=0)
        if b is None:  # only later lanes
            early = np.arange(block.shape[1] * 64)[None, :] <= np.arange(at, at + len(part))[:, None]
            dead |= np.packbits(early, axis=1, bitorder="little").view(np.uint64)
        near = close(block, part, dead)
        if near is None:
            continue
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            found = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little"))
            labels, first = np.unique(label[found], return_index=True)
            if b is None:
                own = label[at + i]
                for x, j in zip(labels.tolist(), found[first].tolist()):
                    if x != own:
                        yield at + i, j
                labels = np.append(labels, own)
            else:
                yield from ((at + i, j) for j in found[first].tolist())
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by group; small groups are compared together, as pairs beyond a group are true links too."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(fp_a, id_a, fp_b=None, id_b=None):
        pairs = list(links(fp_a, fp_b))
        if pairs:
            i, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(id_a[i]), pa.array((id_a if id_b is None else id_b)[j])], schema=schema)

    names = ("split", "one", "two", "tile", "fp", "_id")
    rest: list[np.ndarray] = [np.empty(0, np.int64)] * len(names)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest = [np.concatenate([r, batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)]) for r, n in zip(rest, names)]
            if len(rest[0]) < 4 * TILE:
                continue
        split, one, two, tile, fp, own = rest
        if not len(split):
            continue
        # group numbers: rows of one group lie together
        change = np.flatnonzero(np.append(True, (split[1:] != split[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        ends = np.append(change[1:], len(split))
        whole = len(change) if batch is None else len(change) - 1  # the last group may go on
        fps, at, done = fp.view(np.uint64), None, 0
        for s, e in zip(change[:whole].tolist(), ends[:whole].tolist()):
            done = e
            if one[s] != two[s]:
                left = tile[s:e] == one[s]
                yield from out(fps[s:e][left], own[s:e][left], fps[s:e][~left], own[s:e][~left])
                continue
            if at is None or s != at[1] or e - at[0] > TILE:
                if at is not None:
                    yield from out(fps[at[0] : at[1]], own[at[0] : at[1]])
                at = (s, e)
            else:
                at = (at[0], e)
        if at is not None:
            yield from out(fps[at[0] : at[1]], own[at[0] : at[1]])
        rest = [x[done:] for x in rest]


def blocks_for(n: int) -> int:
    """Into how many blocks 64 bits are cut for n fingerprints."""
    m = RADIUS + 1
    while m < MOST_BLOCKS and n > TILE * 2 ** (64 * (m - RADIUS) // m):
        m += 1
    return m


def masks(m: int) -> list[int]:
    """Bits that two close fingerprints may agree on, for each choice of m - RADIUS of m blocks."""
    cuts = [64 * i // m for i in range(m + 1)]
    part = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(m)]
    return [sum(c) for c in itertools.combinations(part, m - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, n: int, tile: int = TILE, copies: int = COPIES, m: int = 0) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (fp, _id), enough to connect all that are close."""
    m = m or blocks_for(n)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, x in enumerate(masks(m))])
    rows = distinct.select("fp", "_id", F.explode(tables).alias("x")).select("fp", "_id", F.xxhash64("x.t", "x.k").alias("split"))
    sizes = rows.groupBy("split").agg(F.count("*").alias("c")).where(F.col("c") > tile).select("split", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    number = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    dealt = rows.join(sizes, "split", "left").select("fp", "_id", "split", F.coalesce("tiles", F.lit(1)).alias("tiles"), F.coalesce(number, F.lit(0)).alias("tile"))
    hot = m < MOST_BLOCKS and n > copies * tile  # no key can have more fingerprints than there are
    cold = dealt.where(F.col("tiles") <= copies) if hot else dealt
    pairs = cold.select("fp", "_id", "split", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    groups = pairs.select("split", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "fp", "_id")
    found = groups.repartition("split", "one", "two").sortWithinPartitions("split", "one", "two").mapInArrow(_compare, "u long, v long")
    if hot:
        rest = checkpoint(dealt.where(F.col("tiles") > copies).select("fp", "_id").distinct())
        found = found.unionByName(near_links(rest, n, tile, copies, MOST_BLOCKS))
    return found


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    known = rows.where(F.col("_id").isNotNull())
    distinct = known.groupBy("fp").agg(F.min("_id").alias("_id"))
    edges = near_links(distinct, distinct.count()).unionByName(_same_id(known, distinct))
    found = components(edges)
    named = distinct.join(found, distinct["_id"] == found["node"], "left").select("fp", F.coalesce("component", "_id").alias("component_id"))
    out = rows.join(named, "fp", "left")
    component = F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


def _same_id(known: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links between the fingerprints that carry one id (rows with equal ids)."""
    several = known.groupBy("_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("_id")
    pairs = known.join(several, "_id").select(F.col("_id").alias("v"), "fp").distinct()
    return pairs.join(distinct, "fp").select(F.col("_id").alias("u"), "v")


def one_of_each(docs: DataFrame, gone: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose id isn't in `gone` (column _id), one of those with equal ids (that with the smallest hash of its
    text), and all rows without an id; ids: the _id of every row."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    several = checkpoint(ids.where("_id is not null").groupBy("_id").agg(F.count("*").alias("k")).where("k > 1").select("_id").join(gone, "_id", "left_anti"))
    if several.isEmpty():
        return rows.join(gone, "_id", "left_anti").select("_row.*")
    marks = gone.select("_id", F.lit(True).alias("goes")).unionByName(several.select("_id", F.lit(False).alias("goes")))
    marked = rows.join(marks, "_id", "left")
    first = marked.where("not goes").groupBy("_id").agg(F.min_by("_row", F.struct(F.xxhash64("_text"), "_text")).alias("_row"))
    return marked.where("goes is null").select("_row").unionByName(first.select("_row")).select("_row.*")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each component (its smallest id), and the rows without an id, with all columns."""
    found = checkpoint(cluster(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "component_id"))
    return one_of_each(docs, found.where("_id <> component_id").select("_id").distinct(), found.select("_id"), id_col, text_col)
