"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items.

Texts are normalised byte by byte (A-Z lower-cased, ASCII other than letters and digits turned into
separators), so positions of the normalised bytes are positions of the original UTF-8 bytes; words are
then joined by single spaces.  A window is WIDTH consecutive words of an item; an item of fewer words, but not none,
is one window.  A document's words inside any occurrence of a window are hit.

The windows of an item overlap, so the automaton doesn't hold them whole: its patterns are seeds of SEED words, one at
every STRIDE words of an item, and each window holds one of these.  A document is scanned once.  Where a seed occurs,
the windows around it are looked up among the items' windows by a 64-bit hash and compared byte by byte.  So the
automaton has less than half a node per byte of the items (about 20 bytes of memory a byte), and the windows take 12
bytes a word.

The items are a query set whose size is measured first.  Up to BLOCK_BYTES they are one automaton, broadcast as text
and built once a Python worker.  A larger set is scanned for block by block, each an automaton in its turn; only hits
leave such a scan, and they are united by row.

Null or empty texts have no words and no hits; null items match nothing.  Items with equal windows all
count.  Items with a null id are listed as an empty id.  Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows

WIDTH = 10
#: Words of a seed, and the largest distance of seeds at which every window has one.
SEED = 3
STRIDE = WIDTH - SEED + 1
BLOCK_BYTES = 24 << 20
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")
_built: dict[str, object] = {}


def normal(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE)


class Index:
    """The automaton of some (id, text) items, and their windows."""

    def __init__(self, items: list[tuple[str, str]]):
        import ahocorasick

        self.ids, self.automaton = [], ahocorasick.Automaton()
        pieces, starts, sizes, owner, hashes, at = [], [], [], [], [], 0
        digest, lengths = xxhash.xxh3_64_intdigest, set()
        for item, text in items:
            line = b" " + b" ".join(normal(text).split()) + b" "
            space = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            n = len(space) - 1
            if len(line) == 2:
                continue
            width = min(n, WIDTH)
            lengths.add(width)
            for k in range(0, n, STRIDE) if n >= WIDTH else (0,):
                if k + min(SEED, n) <= n:
                    self.automaton.add_word(line[space[k] : space[k + min(SEED, n)] + 1].decode("latin-1"), min(SEED, n))
            begin, end = space[: n - width + 1], space[width:] + 1
            hashes.append(np.array([digest(line[s:e]) for s, e in zip(begin.tolist(), end.tolist())], np.uint64))
            starts.append((begin + at).astype(np.int32))
            sizes.append((end - begin).astype(np.int32))
            owner.append(np.full(len(begin), len(self.ids), np.int32))
            self.ids.append(item)
            pieces.append(line)
            at += len(line)
        self.automaton.make_automaton()
        self.short = sorted(lengths - {WIDTH})
        self.text = b"".join(pieces)
        joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        hashes = joined(hashes, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts, self.sizes, self.owner = (joined(x, np.int32)[order] for x in (starts, sizes, owner))

    def owners(self, window: bytes) -> set[str]:
        """Ids of the items that have a window."""
        h = np.uint64(xxhash.xxh3_64_intdigest(window))
        found = set()
        for k in range(*np.searchsorted(self.hashes, [h, h + np.uint64(1)] if h < ~np.uint64(0) else [h, h]).tolist()):
            s = int(self.starts[k])
            if self.text[s : s + int(self.sizes[k])] == window:
                found.add(self.ids[self.owner[k]])
        return found


def index(key: str, items: Callable[[], list[tuple[str, str]]]) -> Index:
    """The index of a key, built once a worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(items())
    return _built[key]


def marks(text: str | None, a: Index) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged word spans that are hit, ids of the items found."""
    words = normal(text).split()
    n = len(words)
    if not n or not len(a.automaton):
        return n, [], set()
    line = b" " + b" ".join(words) + b" "
    hits = list(a.automaton.iter(line.decode("latin-1")))
    if not hits:
        return n, [], set()
    space = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    ends = np.searchsorted(space, [e for e, _ in hits])  # the space after word k is number k + 1
    begin = ends - [k for _, k in hits]
    places = np.unique(begin[:, None] - np.arange(STRIDE)[None, :])
    wanted = [(s, WIDTH) for s in places[(places >= 0) & (places + WIDTH <= n)].tolist()]
    wanted += [(s, k) for s in np.unique(begin).tolist() for k in a.short if s + k <= n]
    spans, items = [], set()
    for s, k in wanted:
        if found := a.owners(line[space[s] : space[s + k] + 1]):
            spans.append((s, s + k))
            items |= found
    return n, merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of the original text's characters."""
    raw = normal(text)
    at = [m.span() for m in _WORD.finditer(raw)]
    source = text.encode("utf-8", "surrogatepass")
    chars = lambda b: len(source[:b].decode("utf-8", "surrogatepass"))
    return [(chars(at[s][0]), chars(at[e - 1][1])) for s, e in spans]


def blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Callable]:
    """Into how many blocks of about BLOCK_BYTES the items are cut, and what broadcasts one of them and gives its index
    on a worker."""
    items = items.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    n = math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / BLOCK_BYTES)

    def of(b: int) -> Callable[[], Index]:
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else items
        rows = part.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in part.collect()) if n else [])
        key = uuid.uuid4().hex
        return lambda: index(key, lambda: rows.value)

    return n, of


def _digest(ids, rows) -> dict:
    """Columns of the result but the id, from (words, spans, items) rows."""
    hit = [sum(e - s for s, e in spans) for _, spans, _ in rows]
    return {
        "_id": ids,
        "n_words": [n for n, _, _ in rows],
        "n_hit": hit,
        "n_items": [len(x) for _, _, x in rows],
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for _, _, x in rows],
        "contaminated": [h > 0 for h in hit],
    }


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, words hit, items found and their digest."""
    kind = dict(docs.dtypes)[id_col]
    n, of = blocks(items, item_id, item_text)
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = f"_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if n <= 1:
        only = of(0)
        found = map_rows(mine, lambda cols: _digest(cols["_id"], [marks(t, only()) for t in cols["_text"]]), out)
    else:
        found = map_rows(_united(mine, kind, n, of), lambda cols: _digest(cols["_id"], [(k, merged([(x["s"], x["e"]) for x in s]), set(i)) for k, s, i in zip(cols["n"], cols["spans"], cols["items"])]), out)
    return found.withColumnRenamed("_id", id_col)


def _united(mine: DataFrame, kind: str, n: int, of: Callable) -> DataFrame:
    """(_id, n, spans, items) of every row, from a scan for each block: all rows come from the first one, hits from all.

    Rows are told apart by id and digest of the text; equal ones have equal hits, and their number is kept.
    """
    keyed = mine.withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))

    def hits(b: int) -> DataFrame:
        block = of(b)

        def fn(cols: dict) -> dict:
            rows = [(i, k, *marks(t, block())) for i, k, t in zip(cols["_id"], cols["_key"], cols["_text"])]
            rows = [r for r in rows if not b or r[3]]
            return {"_id": [r[0] for r in rows], "_key": [r[1] for r in rows], "n": [r[2] for r in rows], "spans": [[{"s": s, "e": e} for s, e in r[3]] for r in rows], "items": [sorted(r[4]) for r in rows]}

        found = map_rows(keyed, fn, f"_id {kind}, _key string, n long, spans array<struct<s:int,e:int>>, items array<string>")
        return found.withColumn("first", F.lit(int(b == 0)))

    every = hits(0)
    for b in range(1, n):
        every = every.unionByName(hits(b))
    rows = every.groupBy("_id", "_key").agg(F.max("n").alias("n"), F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"), F.sum("first").cast("int").alias("rows"))
    return rows.select("_id", "n", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without any window of any item, with all their columns; rows pass one block after the other."""
    n, of = blocks(items, item_id, item_text)
    for b in range(n):

        def run(batches, block=of(b)):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not marks(t, block())[1] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if b + 1 < n:  # so that no executor holds two automata
            docs = checkpoint(docs)
    return docs
