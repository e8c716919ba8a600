"""Context-tree weighting over bytes: code length of each text under a model of the training documents.

A text is modelled as its bytes with A-Z lower-cased, white space and all, and one END (a byte that UTF-8 never has);
its first bytes have ENDs before them as their context.  Each byte is decomposed into eight binary decisions; a
decision is identified by the bits before it in its byte (255 nodes), and each has its own context tree over the
preceding bytes, up to DEPTH of them.

Training counts zeros and ones at every context node.  A node's Krichevsky-Trofimov estimate gives P_e; its
weighted probability is P_w = (P_e + product of the children's P_w) / 2 inside the tree and P_e at depth DEPTH.
To predict a bit, the KT probabilities along its context path are mixed over all depths with the posterior
weights w = P_e / (2 P_w): the node's own estimate gets w of what is left, deeper ones the rest.  A context that
training hasn't seen is a node without counts: its estimate, and all below it, is 1/2.

Distribution.  The key of a position is its DEPTH preceding bytes (latest first) and the byte.  A part of the
documents sends its distinct keys with their training counts (0 for held-out ones) to the bucket of their root, a
context of their latest bytes, below which all deeper nodes meet.  Roots have ROOT bytes; a context that would hold
more keys than a fair share of a bucket is heavy and split, so that its roots have one byte more, and so on.  Which
are heavy is estimated on a sample of documents of about SAMPLE_BYTES; that decides where work is done, not what comes
out.  Buckets pass weighted probabilities up to the contexts above the roots, down to that of no byte, get the mixture
of these shallow depths back, and answer each part with the log probability of each key it sent.  So the tree is never
in one place: what is gathered grows with the distinct keys of the corpus.  To all go only the heavy contexts, at most
64 MiB (see `heavy`).  Texts are shuffled once.  Log probabilities travel as 32-bit numbers (relative error up to 6e-8
each).

The base score (add-0.1 smoothed token frequencies) goes the same way with hashed tokens (64 bits); the corpus
totals, two numbers, are sent to every part.

Null and empty texts consist of the end alone.  Rows with a null id are held out.  Repeated rows are scored
each for itself and counted each.  Without any training row every bit has probability 1/2.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, splitmix
from .exchange import MESSAGE, PART_BYTES, Outbox, address, answer, deal, finish, gathered, ids, inbox, lookup, send, texts, thin, unpack

DEPTH = 6
FOLDS = 10
CHUNK = 1 << 19
#: A byte that no UTF-8 text has: the end of a text, and what comes before its beginning.
END = b"\xff"
#: Context bytes that decide the bucket, where the context isn't heavy.
ROOT = 2
#: Bytes of text on which the heavy contexts are estimated, and the least share of keys that makes a context heavy.
SAMPLE_BYTES = 16 << 20
LEAST_SHARE = 1 / (1 << 18)
_LN2 = math.log(2.0)
_HALF = math.lgamma(0.5)
_32 = np.uint64(32)


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def serial(raw: bytes) -> bytes:
    return raw.lower() + END


def held_out(own: np.ndarray) -> np.ndarray:
    """By the contract's checksum of the id; a null id (largest number) is held out."""
    return np.array([i == 2**63 - 1 or zlib.crc32(str(i).encode()) % FOLDS == 0 for i in own.tolist()], bool)


def keys_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every byte, which of the texts it is in)."""
    pad = END * DEPTH
    blob = np.frombuffer(b"".join([x for r in rows for x in (pad, r)]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.arange(sizes.sum()) + np.repeat(DEPTH * np.arange(1, len(rows) + 1), sizes)
    n = len(blob)
    key = blob[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        key |= blob[DEPTH - j : n - j] << np.uint64(8 * (DEPTH + 1 - j))
    return key[at - DEPTH], np.repeat(np.arange(len(rows)), sizes)


def chunks(data: list[bytes], most: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and serial texts, about `most` bytes at a time."""
    rows, parts, size = [], [], 0
    for i, raw in enumerate(data):
        rows.append(i)
        parts.append(serial(raw))
        size += len(parts[-1])
        if size >= most:
            yield rows, parts
            rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def part_keys(data: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a part, sorted, and their counts in its training rows."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for rows, parts in chunks(data):
        for kind in (False, True):
            mine = [p for r, p in zip(rows, parts) if held[r] == kind]
            if mine:
                found, times = counted(np.sort(keys_of(mine)[0]))
                keys.append(found)
                counts.append(np.zeros(len(found), np.int64) if kind else times)
    return summed(np.concatenate(keys), np.concatenate(counts))


def context_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The latest `depth` bytes of the keys' contexts."""
    return keys >> np.uint64(8 * (DEPTH + 1 - depth))


class Roots:
    """Which contexts are heavy, by depth (sorted); those of ROOT - 1 bytes and fewer all are, in effect.

    Contexts above roots, the shallow ones, are addressed by numbers below 0, buckets by numbers from 0 on.
    """

    def __init__(self, heavy: dict[int, np.ndarray]):
        self.heavy = heavy
        self.first, self.levels, total = {}, list(range(ROOT)), 0
        for d in range(ROOT):
            self.first[d] = total
            total += 1 << (8 * d)
        for d in sorted(heavy):
            self.first[d] = total
            total += len(heavy[d])
            self.levels.append(d)

    def depths(self, keys: np.ndarray) -> np.ndarray:
        """Bytes of each key's root."""
        out = np.full(len(keys), ROOT)
        for d in sorted(self.heavy):
            out[lookup(self.heavy[d], context_of(keys, d))[1]] = d + 1
        return out

    def buckets(self, keys: np.ndarray, n: int) -> np.ndarray:
        depth = self.depths(keys)
        root = keys >> (np.uint64(8) * (DEPTH + 1 - depth).astype(np.uint64))
        return (address(splitmix((root << np.uint64(3)) + depth.astype(np.uint64)), n) >> _32).astype(np.int64)

    def code(self, context: np.ndarray, depth: int) -> np.ndarray:
        """Addresses of shallow contexts."""
        place = np.searchsorted(self.heavy[depth], context) if depth in self.heavy else context.astype(np.int64)
        return -1 - (self.first[depth] + place)

    def above(self, code: int) -> int:
        """Address of the context without its oldest byte."""
        depth = self.depth(code)
        place = -1 - code - self.first[depth]
        context = self.heavy[depth][place] if depth in self.heavy else np.uint64(place)
        return int(self.code(np.asarray([context >> np.uint64(8)], np.uint64), depth - 1)[0])

    def depth(self, code: int) -> int:
        return max(d for d in self.levels if self.first[d] <= -1 - code)


def heavy(docs: DataFrame, id_col: str, text_col: str, n: int, every: int) -> Roots:
    """Contexts of ROOT to DEPTH - 1 bytes with more than half a bucket's share of distinct keys, in one row of `every`.

    A key counts once in each chunk of texts.  A share is LEAST_SHARE at least and a context of d bytes is heavy only if
    its d - 1 latest bytes are, so there are at most 2 / LEAST_SHARE of each depth: 16 MiB of numbers, on the driver too.
    """
    if n == 1:
        return Roots({})
    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(every)) == 0).select(F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for _, parts in chunks(texts(pa.table({"_text": batch.column(0)})), 4 * CHUNK):
                keys = counted(np.sort(keys_of(parts)[0]))[0]
                depth, context, times = [np.zeros(1, np.int32)], [np.zeros(1, np.uint64)], [np.array([len(keys)])]
                for d in range(ROOT, DEPTH):
                    found, k = counted(context_of(keys, d))
                    keep = k * 16 * n > len(keys)  # what is rarer than that here counts for little
                    depth.append(np.full(keep.sum(), d, np.int32))
                    context.append(found[keep])
                    times.append(k[keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(depth)), pa.array(np.concatenate(context).astype(np.int64)), pa.array(np.concatenate(times))], names=["d", "c", "k"])

    found = some.mapInArrow(run, "d int, c long, k long").groupBy("d", "c").agg(F.sum("k").alias("k"))
    found = checkpoint(found)
    total = found.where("d = 0").first()
    rows = found.where((F.col("d") > 0) & (F.col("k") > max(0.5 / n, LEAST_SHARE) * (total["k"] if total else 0))).select("d", "c").collect()
    out: dict[int, np.ndarray] = {}
    for d in range(ROOT, DEPTH):
        mine = np.sort(np.array([r[1] for r in rows if r[0] == d], np.int64).astype(np.uint64))
        if d > ROOT:
            mine = mine[lookup(out.get(d - 1, np.empty(0, np.uint64)), mine >> np.uint64(8))[1]]
        if not len(mine):
            break
        out[d] = mine
    return Roots(out)


def part_tokens(data: list[bytes], held: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of a part ordered by hash, hashes, counts in training rows (the end is a newline)."""
    train: Counter = Counter()
    for raw, out in zip(data, held.tolist()):
        if out:
            for w in tokens(raw):
                train.setdefault(w, 0)
        else:
            train.update(tokens(raw))
    train[b"\n"] += int((~held).sum())
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in train], np.uint64)
    order = np.argsort(hashes, kind="stable")
    names = list(train)
    return [names[i] for i in order.tolist()], hashes[order], np.fromiter(train.values(), np.int64, len(train))[order]


def _announce(n: int, roots: Roots):
    def fn(part: int, table: pa.Table, out: Outbox) -> None:
        data, held = texts(table), held_out(ids(table))
        keys, counts = part_keys(data, held)
        dest = roots.buckets(keys, n)
        order = np.argsort(dest, kind="stable")
        out.scatter(n, dest[order], keys[order], counts[order].astype(np.uint32))
        _, hashes, times = part_tokens(data, held)
        out.scatter(n, (address(hashes, n) >> _32) + np.uint64(n), hashes, times.astype(np.uint32))

    return fn


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4096) + 0.5))]) + _HALF  # lgamma(k + 1/2)
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])  # lgamma(k + 1)


def _gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of large x by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    n = zeros + ones
    return _lookup(_SMALL, zeros, 0.5) + _lookup(_SMALL, ones, 0.5) - _lookup(_WHOLE, n, 1.0) - 2 * _HALF


def _lookup(table: np.ndarray, k: np.ndarray, plus: float) -> np.ndarray:
    """log gamma of k + plus: from the table, or by the series where k is beyond it."""
    out = table[np.minimum(k, len(table) - 1)]
    large = np.flatnonzero(k >= len(table))
    out[large] = _gamma(k[large] + plus)
    return out


class Level:
    """The nodes of one depth: rows are (context, byte) keys, nodes of bit k are (context, k leading bits)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.node, self.first, self.zeros, self.ones = [], [], [], []
        for k in range(8):
            prefix = keys >> np.uint64(8 - k)
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            one = np.where((keys >> np.uint64(7 - k)) & np.uint64(1), counts, 0)
            total, ones = np.add.reduceat(counts, first), np.add.reduceat(one, first)
            self.node.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))))
            self.first.append(first)
            self.ones.append(ones)
            self.zeros.append(total - ones)

    def kt(self, k: int) -> np.ndarray:
        """Probability of a one."""
        return (self.ones[k] + 0.5) / (self.zeros[k] + self.ones[k] + 1.0)


class Tree:
    """All nodes of depths root to DEPTH below some contexts of root bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, root: int):
        self.root = root
        self.levels, self.up = {DEPTH: Level(keys, counts)}, {}
        for d in range(DEPTH - 1, root - 1, -1):
            below = self.levels[d + 1]
            shorter = ((below.keys >> np.uint64(16)) << np.uint64(8)) | (below.keys & np.uint64(255))
            own, inverse = np.unique(shorter, return_inverse=True)
            self.up[d + 1] = inverse
            self.levels[d] = Level(own, np.bincount(inverse, below.counts, len(own)).astype(np.int64))
        self.own = {DEPTH: [log_kt(z, o) for z, o in zip(self.levels[DEPTH].zeros, self.levels[DEPTH].ones)]}
        self.weighted = {DEPTH: self.own[DEPTH]}
        for d in range(DEPTH - 1, root - 1, -1):
            level = self.levels[d]
            self.own[d], self.weighted[d] = [], []
            for k in range(8):
                own = log_kt(level.zeros[k], level.ones[k])
                deep = np.bincount(self.parent(d + 1, k), self.weighted[d + 1][k], len(own))
                self.own[d].append(own)
                self.weighted[d].append(np.logaddexp(own, deep) - _LN2)

    def parent(self, d: int, k: int) -> np.ndarray:
        """Node at depth d - 1 of each node at depth d."""
        return self.levels[d - 1].node[k][self.up[d][self.levels[d].first[k]]]

    def shallow(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(context of root - 1 bytes, sums of weighted logs of its children by node, counts by byte)."""
        level = self.levels[self.root]
        context = level.keys >> np.uint64(16)
        listed = np.unique(context)
        place = np.searchsorted(listed, context)
        byte = (level.keys & np.uint64(255)).astype(np.int64)
        counts = np.bincount(place * 256 + byte, level.counts, len(listed) * 256).astype(np.int64).reshape(-1, 256)
        sums = np.zeros(len(listed) * 255)
        for k in range(8):
            first = level.first[k]
            node = (1 << k) - 1 + (byte[first] >> (8 - k))
            sums += np.bincount(place[first] * 255 + node, self.weighted[self.root][k], len(sums))
        yield from zip(listed, sums.reshape(-1, 255), counts)

    def log10(self, listed: np.ndarray, mixed_above: np.ndarray, left_above: np.ndarray) -> np.ndarray:
        """Log10 probability of each key's byte; listed: contexts of root - 1 bytes, in order, with what shallower depths
        give and leave for their 255 nodes."""
        out = np.zeros(len(self.levels[DEPTH].keys))
        for k in range(8):
            level = self.levels[self.root]
            at = level.keys[level.first[k]]
            place = np.searchsorted(listed, at >> np.uint64(16))
            node = (1 << k) - 1 + ((at & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
            mixed, left = mixed_above[place, node], left_above[place, node]
            for d in range(self.root, DEPTH + 1):
                level = self.levels[d]
                if d > self.root:
                    up = self.parent(d, k)
                    mixed, left = mixed[up], left[up]
                weight = np.exp(self.own[d][k] - _LN2 - self.weighted[d][k]) if d < DEPTH else 1.0
                mixed, left = descend(level.kt(k), weight, mixed, left)
            p = mixed[level.node[k]]
            bit = (level.keys >> np.uint64(7 - k)) & np.uint64(1)
            out += np.log10(np.where(bit, p, 1 - p))
        return out


def descend(kt, weight, mixed, left):
    """One depth further: (mixture so far, weight left for deeper depths)."""
    return mixed + left * weight * kt, left * (1 - weight)


def split_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the 255 nodes from counts by byte."""
    zeros, ones = [], []
    for k in range(8):
        pairs = counts.reshape(1 << k, 2, -1).sum(axis=2)
        zeros.append(pairs[:, 0])
        ones.append(pairs[:, 1])
    return np.concatenate(zeros), np.concatenate(ones)


def shallow_node(got: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts by byte, weighted logs, weights, KT probabilities) of a shallow context, from its children."""
    deep = gathered(got, 0, np.float64).reshape(-1, 255).sum(axis=0)
    counts = gathered(got, 1, np.int64).reshape(-1, 256).sum(axis=0)
    zeros, ones = split_counts(counts)
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, deep) - _LN2
    return counts, weighted, np.exp(own - _LN2 - weighted), (ones + 0.5) / (zeros + ones + 1.0)


def _bucket_keys(got: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, their counts, and the place of each key that was sent."""
    sent = gathered(got, 0, np.uint64)
    keys, inverse = np.unique(sent, return_inverse=True)
    return keys, np.bincount(inverse, gathered(got, 1, np.uint32), len(keys)).astype(np.int64), inverse


def _trees(keys: np.ndarray, counts: np.ndarray, roots: Roots) -> Iterator[tuple[np.ndarray, Tree]]:
    """(places of the keys, tree) for each depth of root in a bucket."""
    depth = roots.depths(keys)
    for d in np.unique(depth).tolist():
        mine = np.flatnonzero(depth == d)
        yield mine, Tree(keys[mine], counts[mine], d)


def _up(n: int, roots: Roots):
    """Buckets of keys: weighted probabilities to the contexts one byte shorter than roots.  Buckets of tokens: none."""

    def fn(bucket: int, got: list, out: Outbox) -> None:
        if bucket < n:
            keys, counts, _ = _bucket_keys(got)
            for _, tree in _trees(keys, counts, roots):
                listed, sums, by_byte = zip(*tree.shallow())
                for code, x, y in zip(roots.code(np.array(listed, np.uint64), tree.root - 1).tolist(), sums, by_byte):
                    out.put(code, x, y)

    return fn


def _pass_up(roots: Roots, level: int):
    """Shallow contexts of a depth to those without their oldest byte; what is meant for others goes on to them."""

    def fn(code: int, got: list, out: Outbox) -> None:
        if roots.depth(code) == level:
            counts, weighted, _, _ = shallow_node(got)
            out.put(roots.above(code), weighted, counts)
        else:
            out.forward(code, got)

    return fn


def _from_top(code: int, got: list, out: Outbox) -> None:
    _, _, weight, kt = shallow_node(got)
    answer_ = descend(kt, weight, np.zeros(255), np.ones(255))
    for m in got:
        out.put(m[0], *answer_)


def _both(left: DataFrame, right: DataFrame, fn) -> DataFrame:
    """Messages of those who got messages of two kinds."""
    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = Outbox(key[0].as_py())
        fn(out.src, list(inbox(a)), list(inbox(b)), out)
        return out.table()

    return left.groupBy("dest").cogroup(right.groupBy("dest")).applyInArrow(run, MESSAGE)


def _pass_down(roots: Roots, level: int):
    """Shallow contexts of a depth to whom they heard from; what is meant for others goes on to them."""

    def fn(code: int, got: list, above: list, out: Outbox) -> None:
        if code < 0 and roots.depth(code) == level:
            _, _, weight, kt = shallow_node(got)
            mixed, left = (unpack(x, np.float64) for x in above[0][1:3])
            answer_ = descend(kt, weight, mixed, left)
            for m in got:
                out.put(m[0], *answer_)
        else:
            out.forward(code, above)

    return fn


def _tell(n: int, roots: Roots):
    """To each part: log probabilities of its keys, counts of its tokens, in the order sent."""

    def fn(bucket: int, got: list, above: list, out: Outbox) -> None:
        keys, counts, inverse = _bucket_keys(got)
        if bucket < n:
            tops = {m[0]: (unpack(m[1], np.float64), unpack(m[2], np.float64)) for m in above}
            logs = np.empty(len(keys), np.float32)
            for mine, tree in _trees(keys, counts, roots):
                listed = np.unique(context_of(tree.levels[DEPTH].keys, tree.root - 1))
                mixed, left = (np.stack(x) for x in zip(*[tops[c] for c in roots.code(listed, tree.root - 1).tolist()]))
                logs[mine] = tree.log10(listed, mixed, left)
            told = logs[inverse]
        else:
            told = counts[inverse]
        s = 0
        for m in got:
            e = s + len(m[1]) // 8
            out.put(m[0], told[s:e])
            s = e

    return fn


def _count_tokens(n: int):
    """Buckets of tokens: training tokens and how many distinct ones, to one place."""

    def fn(bucket: int, got: list, out: Outbox) -> None:
        if bucket >= n:
            counts = _bucket_keys(got)[1]
            out.put(0, np.array([counts.sum(), (counts > 0).sum()]))

    return fn


def _spread_totals(n: int):
    def fn(_: int, got: list, out: Outbox) -> None:
        total = gathered(got, 0, np.int64).reshape(-1, 2).sum(axis=0)
        for part in range(n):
            out.put(part, total, None, np.ones(1, np.uint8))

    return fn


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 3 * PART_BYTES // 4, roots: Roots | None = None) -> DataFrame:
    """One row per input row: fold, tokens, known tokens, training tokens, base score, score, bits per byte."""
    dealt, n = deal(docs, id_col, text_col, part_bytes)
    mine = thin(dealt)
    roots = roots or heavy(docs, id_col, text_col, n, max(1, n * part_bytes // SAMPLE_BYTES))
    messages = send(mine, _announce(n, roots))
    totals = answer(answer(messages, _count_tokens(n)), _spread_totals(n))
    up = [answer(messages, _up(n, roots))]  # to shallow contexts; after each pass those of one depth are done
    for level in roots.levels[:0:-1]:
        up.append(answer(up[-1], _pass_up(roots, level)))
    down = answer(up.pop(), _from_top)
    for level in roots.levels[1:]:
        down = _both(up.pop(), down, _pass_down(roots, level))
    told = _both(messages, down, _tell(n, roots))

    def fn(part: int, table: pa.Table, got: list) -> dict:
        data, held = texts(table), held_out(ids(table))
        score_, size = _scores(data, [m for m in got if not m[3] and m[0] < n], n, roots)
        n_tokens, known, base = _base(data, held, [m for m in got if not m[3] and m[0] >= n])
        train, distinct = gathered([m for m in got if m[3]], 0, np.int64).tolist()
        return {
            id_col: table.column("_id"),
            "held_out": held,
            "n_tokens": n_tokens,
            "n_known": known,
            "train_tokens": np.full(len(data), train),
            "base_score": base - n_tokens * math.log10(train + 0.1 * (distinct + 1)),
            "score": score_,
            "bits_per_byte": -score_ / size / math.log10(2.0),
        }

    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return finish(mine, told.unionByName(totals), fn, schema)


def _scores(data: list[bytes], got: list, n: int, roots: Roots) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability and bytes of each text, from what the buckets tell of the part's keys."""
    made, size = [], np.zeros(len(data), np.int64)
    for rows, parts in chunks(data):
        key, row = keys_of(parts)
        order = np.argsort(key)
        found, times = counted(key[order])
        made.append((rows, found, times.astype(np.uint32), row[order].astype(np.uint16 if len(rows) < 1 << 16 else np.uint32)))
        size[rows] = [len(p) for p in parts]
    keys = counted(np.sort(np.concatenate([m[1] for m in made])))[0]
    logs = np.empty(len(keys), np.float32)
    logs[np.argsort(roots.buckets(keys, n), kind="stable")] = gathered(got, 0, np.float32)
    total = np.zeros(len(data))
    for rows, found, times, row in made:
        each = np.repeat(logs[np.searchsorted(keys, found)], times)
        total[rows] = np.bincount(row, each, len(rows))
    return total, size


def _base(data: list[bytes], held: np.ndarray, got: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens and sum of log10(count + 0.1) of each text."""
    words, _, _ = part_tokens(data, held)
    place = {w: i for i, w in enumerate(words)}
    counts = gathered(got, 0, np.int64)
    rate, there, end = np.log10(counts + 0.1), (counts > 0).astype(np.int64), place[b"\n"]
    size, known, base = np.ones(len(data), np.int64), np.full(len(data), there[end]), np.full(len(data), rate[end])
    for i, raw in enumerate(data):
        own = tokens(raw)
        if own:
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            size[i] += len(own)
            known[i] += there[at].sum()
            base[i] += rate[at].sum()
    return size, known, base
