"""Exact removal of repeated byte strings, after prefix-free parsing.

A byte goes if a string of WIDTH (50) bytes that covers it also starts in a document with a smaller id.

Parsing.  A rolling hash over GRAM bytes gives every WIDTH-byte string a key, the smallest hash of a gram in it; a
series of strings with one key is a run.  One gram in EVERY is a trigger: a phrase ends where the run of a trigger
begins, and the next one begins there.  Strings overlap, so phrases do, by WIDTH - 1 bytes; every string lies in
exactly one run of exactly one phrase.  Where runs and phrases begin and end depends on the bytes there alone, so
copies have the same phrases.  The distinct phrases are the dictionary, a document's series of phrases is its parse.

The parse.  Buckets of phrase digests (128 bits) tell the parts which of their phrases a smaller id has: there all
of the phrase goes.  A phrase stays in the dictionary where its smallest id is, so from here on the work follows the
distinct text, not the copies.

The dictionary.  Equal strings of different phrases have equal keys.  Parts first announce the keys; a key that only
one run has is settled.  Runs with shared keys meet in a bucket of the key, each distinct one sent once by a part.
There they are a corpus of their own, highly repetitive: the suffix arrays of its dictionary and of its parse combine
into corpus order (see `pfp`), equal WIDTH-byte strings are neighbours in it, compared byte by byte, and each run of
equal ones gets its smallest id.  The strings of a key that has more than HOT runs, however many parts they come from, don't meet
in one place: they are sent one by one, to buckets of their own hash.

Nothing is removed on the equality of short hashes: those only decide what is compared.

Ids are integers; a null id counts as larger than any other.  Rows with equal ids never remove from each
other.  Null and empty texts, and texts under WIDTH bytes, keep everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import splitmix
from .exchange import PART_BYTES, Outbox, address, answer, deal, finish, gathered, ids, joined, lookup, low, resend, send, texts, thin, unpack
from .pfp import Corpus

WIDTH = 50
GRAM = 16
#: One run in so many begins a phrase.
EVERY = 16
CHUNK = 1 << 17
#: Strings of a run at most: as many as can share one gram.  Only periodic texts would have longer runs.
LONGEST = WIDTH - GRAM + 1
#: Runs of one key from which its strings are dealt one by one (from half as many, as counts are rounded up).
HOT = 1 << 16
#: Runs of one key that a part counts exactly.
EXACT = 220
_PRIME = 0x9E3779B97F4A7C15
_32 = np.uint64(32)
#: Buckets of runs for each bucket of keys, as a power of two: runs are larger than keys.
_SUB = np.uint64(2)
#: Slices of a bucket that are settled one after the other, as a power of two.
_SLICE = np.uint64(4)
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])
_ABOUT = np.dtype([("count", "u1"), ("slice", "u1")])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_table = {"power": _powers(1, _PRIME), "inverse": _powers(1, _PRIME)}


def prefixes(raw: bytes) -> np.ndarray:
    """Prefix sums of byte values times powers, modulo 2^64."""
    n = len(raw)
    if len(_table["power"]) <= n:
        _table["power"], _table["inverse"] = _powers(n + CHUNK, _PRIME), _powers(n + CHUNK, pow(_PRIME, -1, 1 << 64))
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((np.frombuffer(raw, np.uint8) + np.uint64(1)) * _table["power"][:n], out=out[1:])
    return out


def hashes(prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hashes of pieces, wherever they stand."""
    with np.errstate(over="ignore"):
        return (prefix[start + size] - prefix[start]) * _table["inverse"][start]


class Slab:
    """Some texts (or phrases) in a row, with prefix hashes; only those of WIDTH bytes or more."""

    def __init__(self, rows: list[int], offsets: list[int], data: list[bytes]):
        self.raw = b"".join(data)
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.rows, self.offsets = np.asarray(rows, np.int64), np.asarray(offsets, np.int64)
        self.prefix = prefixes(self.raw)

    def grams(self) -> np.ndarray:
        n = len(self.raw) - GRAM + 1
        return splitmix(hashes(self.prefix, np.arange(n), GRAM)) if n > 0 else np.empty(0, np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, row, place in the row, strings, whether a phrase begins) of every run of strings with one key."""
        least, span, want = self.grams(), 1, WIDTH - GRAM + 1
        while span < want and len(least):
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        # Strings stay within their text.
        piece = np.repeat(np.arange(len(self.size)), self.size)[: len(least)]
        inside = np.flatnonzero(np.arange(len(least)) + WIDTH <= self.end[piece])
        key, own = least[inside], piece[inside]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.empty(0, np.int64)
        run = np.diff(np.append(first, len(key)))
        if len(run) and run.max() > LONGEST:  # texts of a short period
            parts = -(-run // LONGEST)
            first = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.diff(np.append(first, len(key)))
        # Smallest hashes crowd at 0; mixed anew, keys are dealt evenly.
        start, own, key = inside[first], own[first], splitmix(key[first] + np.uint64(_PRIME))
        begins = (key % np.uint64(EVERY) == 0) | np.append(True, own[1:] != own[:-1])[: len(own)]
        return key, self.rows[own], start - self.begin[own] + self.offsets[own], count, begins


def slabs(data: list[bytes]) -> Iterator[Slab]:
    """All texts, about CHUNK bytes at a time; a longer text comes in pieces that share WIDTH - 1 bytes."""
    rows, offsets, parts, size = [], [], [], 0
    for row, raw in enumerate(data):
        for at in range(0, max(1, len(raw) - WIDTH + 1), CHUNK):
            part = raw[at : at + CHUNK + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield Slab(rows, offsets, parts)
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield Slab(rows, offsets, parts)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def in_a_byte(count: np.ndarray) -> np.ndarray:
    """Counts up to EXACT as they are, larger ones as the power of two times EXACT that isn't smaller."""
    more = np.ceil(np.log2(np.maximum(count, EXACT) / EXACT)).astype(np.int64)
    return np.where(count > EXACT, EXACT + more, count).astype(np.uint8)


def from_a_byte(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code > EXACT, EXACT << np.maximum(code - EXACT, 0), code)


class Parse:
    """The runs of a part's texts, in phrases: row, place, strings and number of each phrase; the distinct ones by digest,
    with the part's smallest id and one place where each stands."""

    def __init__(self, data: list[bytes], own: np.ndarray):
        self.data = data
        none = np.empty(0, np.int64)
        made = [slab.runs() for slab in slabs(data)] or [(np.empty(0, np.uint64), none, none, none, np.empty(0, bool))]
        self.run_key, self.run_row, self.run_at, self.run_count, begins = (np.concatenate(x) for x in zip(*made))
        self.first = np.flatnonzero(begins)
        self.runs = np.diff(np.append(self.first, len(begins)))
        self.row, self.at = self.run_row[self.first], self.run_at[self.first]
        self.count = np.add.reduceat(self.run_count, self.first) if len(self.first) else none
        digest = xxhash.xxh3_128_digest
        found = [digest(data[r][s:e]) for r, s, e in zip(self.row.tolist(), self.at.tolist(), (self.at + self.count + WIDTH - 1).tolist())]
        found = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        order = np.lexsort((found[:, 1], found[:, 0]))
        found = found[order]
        first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]).any(axis=1))) if len(order) else none
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.key = np.empty(len(first), _KEY)
        self.key["hi"], self.key["lo"] = found[first, 0], found[first, 1]
        self.one = order[first]
        self.least = np.minimum.reduceat(own[self.row][order], first) if len(first) else none

    def told(self, got: list, n: int) -> None:
        """Takes in which phrases a smaller id has elsewhere; `kept` numbers the phrases for which there is none."""
        bucket = address(self.key["hi"], n) >> _32
        elsewhere = np.zeros(len(self.key), bool)
        for src, place, least, _ in got:
            if src < n:
                mine = np.searchsorted(bucket, src) + unpack(place, np.uint32).astype(np.int64)
                self.least[mine] = unpack(least, np.int64)
                elsewhere[mine] = True
        self.kept = np.flatnonzero(~elsewhere)

    def kept_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(run, phrase) of the runs of the phrases that are kept, each phrase once."""
        times = self.runs[self.one[self.kept]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(self.first[self.one[self.kept]], times) + step, np.repeat(self.kept, times)


def _announce_phrases(n: int):
    def fn(part: int, table: pa.Table, out: Outbox) -> None:
        parse = Parse(texts(table), ids(table))
        out.scatter(n, address(parse.key["hi"], n) >> _32, parse.key, parse.least)

    return fn


def _owners(bucket: int, got: list, out: Outbox) -> None:
    """Tell each part which of its phrases (by place in its message) a smaller id has, and this id."""
    key, owner = gathered(got, 0, _KEY), gathered(got, 1, np.int64)
    order = np.lexsort((key["lo"], key["hi"]))
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(key))))
    s = 0
    for m in got:
        e = s + len(m[1]) // _KEY.itemsize
        less = np.flatnonzero(least[s:e] < owner[s:e])
        if len(less):
            out.put(m[0], less.astype(np.uint32), least[s:e][less])
        s = e


def _announce_keys(n: int):
    """Keys of the runs of the phrases that are kept, with the number of these runs in a byte (see `in_a_byte`)."""

    def fn(part: int, table: pa.Table, got: list, out: Outbox) -> None:
        parse = Parse(texts(table), ids(table))
        parse.told(got, n)
        key = np.sort(address(parse.run_key[parse.kept_runs()[0]], n))
        at = groups(key)
        out.scatter(n, (key[at] >> _32) + np.uint64(n), low(key[at]), in_a_byte(np.diff(np.append(at, len(key)))))

    return fn


def _shared(n: int, hot: int):
    """Tell each part which of its keys several runs have, and which of these very many."""

    def fn(bucket: int, got: list, out: Outbox) -> None:
        keys, count = gathered(got, 0, np.uint32), from_a_byte(gathered(got, 1, np.uint8))
        src = np.repeat([m[0] for m in got], [len(m[1]) // 4 for m in got])
        order = np.argsort(keys, kind="stable")
        at = groups(keys[order])
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], at), np.diff(np.append(at, len(keys))))
        mine = np.flatnonzero(total > 1)
        for a in np.split(mine, np.flatnonzero(np.diff(src[mine])) + 1) if len(mine) else []:
            a = a[np.argsort(keys[a], kind="stable")]
            out.put(int(src[a[0]]), keys[a], (total[a] > hot).astype(np.uint8))

    return fn


class Runs:
    """A part's runs with shared keys: phrase, place in it, strings and number of each; the distinct ones by slice of a
    bucket and content, with the part's smallest id.  Strings of hot keys are runs of one."""

    def __init__(self, parse: Parse, got: list, n: int):
        got = [m for m in got if n <= m[0] < 2 * n]
        table = np.concatenate([joined(m[0] - n, unpack(m[1], np.uint32)) for m in got]) if got else np.empty(0, np.uint64)
        hot = gathered(got, 1, np.uint8)
        order = np.argsort(table, kind="stable")
        table, hot = table[order], hot[order]
        run, phrase = parse.kept_runs()
        key = address(parse.run_key[run], n)
        where, there = lookup(table, key)
        mine = np.flatnonzero(there)
        run, phrase, key, single = run[mine], phrase[mine], key[mine], hot[where[mine]] > 0 if len(table) else np.zeros(0, bool)
        row, at, count = parse.run_row[run], parse.run_at[run], parse.run_count[run]
        if single.any():  # every string on its own
            times = np.where(single, count, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            phrase, key, single, row, at, count = (np.repeat(x, times) for x in (phrase, key, single, row, at, count))
            at, count = at + step, np.where(single, 1, count)
        number, seen, data = [], {}, parse.data
        dest = (key >> (_32 - _SUB - _SLICE)).tolist()
        for r, s, e, d, alone in zip(row.tolist(), at.tolist(), (at + count + WIDTH - 1).tolist(), dest, single.tolist()):
            x = data[r][s:e]
            number.append(seen.setdefault((_bucket(x, n) if alone else d, x), len(seen)))
        self.phrase, self.at, self.count = phrase, at - parse.at[parse.one[phrase]], count
        listed = sorted(seen)
        rank = np.empty(len(seen), np.int64)
        rank[[seen[x] for x in listed]] = np.arange(len(seen))
        self.number = rank[np.asarray(number, np.int64)]
        self.dest, self.content = [d for d, _ in listed], [x for _, x in listed]
        self.least = np.full(len(seen), 2**63 - 1)
        np.minimum.at(self.least, self.number, parse.least[self.phrase])


def _bucket(string: bytes, n: int) -> int:
    return xxhash.xxh3_64_intdigest(string) * (n << int(_SUB + _SLICE)) >> 64


def _send_runs(n: int):
    """Distinct runs to their buckets, which come after those of phrases and keys."""

    def fn(part: int, table: pa.Table, got: list, out: Outbox) -> None:
        parse = Parse(texts(table), ids(table))
        parse.told(got, n)
        runs = Runs(parse, got, n)
        size = np.fromiter(map(len, runs.content), np.int64, len(runs.content))
        dest, slice_ = np.divmod(np.asarray(runs.dest, np.int64), 1 << int(_SLICE))
        cuts = groups(dest).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(size)]):
            about = np.stack([size[s:e] - (WIDTH - 1), slice_[s:e]], axis=1).astype(np.uint8)
            out.put(2 * n + int(dest[s]), np.frombuffer(b"".join(runs.content[s:e]), np.uint8), about.reshape(-1).view(_ABOUT), runs.least[s:e])

    return fn


def _settle(bucket: int, got: list, out: Outbox) -> None:
    """Tell each part, for each run it sent, which of its strings a smaller id has (a bit each).

    Runs with different keys have no string in common, so the bucket is settled slice by slice of the keys.
    """
    about = [unpack(m[2], _ABOUT) for m in got]
    owner = [unpack(m[3], np.int64) for m in got]
    ends = [np.cumsum(a["count"].astype(np.int64) + WIDTH - 1) for a in about]
    bits = [np.zeros(len(a), np.uint64) for a in about]
    for k in range(1 << int(_SLICE)):
        cut = [np.searchsorted(a["slice"], [k, k + 1]).tolist() for a in about]
        seen: dict[bytes, int] = {}
        number = []
        for m, a, end, (s, e) in zip(got, about, ends, cut):
            stop = end[s:e].tolist()
            start = (end[s:e] - a["count"][s:e].astype(np.int64) - (WIDTH - 1)).tolist()
            number.append(np.asarray([seen.setdefault(m[1][i:j], len(seen)) for i, j in zip(start, stop)], np.int64))
        least = _least_ids(seen, np.concatenate(number), np.concatenate([o[s:e] for o, (s, e) in zip(owner, cut)]))
        for mine, a, o, b, (s, e) in zip(number, about, owner, bits, cut):
            count = a["count"][s:e].astype(np.int64)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            less = least[0][np.repeat(least[1][mine], count) + step] < np.repeat(o[s:e], count)
            np.bitwise_or.at(b, s + np.repeat(np.arange(len(count)), count)[less], np.uint64(1) << step[less].astype(np.uint64))
    for m, b in zip(got, bits):
        out.put(m[0], b)


def _repeating(runs: list[bytes]) -> np.ndarray:
    """Which runs have a string whose hash another place has too; without one, none of a run's strings is repeated."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    begin, count = np.cumsum(size) - size, size - (WIDTH - 1)
    run = np.repeat(np.arange(len(runs)), count)
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = hashes(prefixes(b"".join(runs)), at, WIDTH)
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    out = np.zeros(len(runs), bool)
    out[run[order[1:][same]]] = True
    out[run[order[:-1][same]]] = True
    return out


def _least_ids(runs: dict[bytes, int], number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id of the string that begins at each place of the distinct runs, where each of these begins)."""
    least = np.full(len(runs), 2**63 - 1)
    np.minimum.at(least, number, owner)
    listed = list(runs)
    size = np.fromiter(map(len, listed), np.int64, len(listed))
    begin, again = np.cumsum(size) - size, np.flatnonzero(_repeating(listed))
    at = np.repeat(least, size)
    corpus = Corpus([listed[i] for i in again.tolist()])
    place, string = corpus.equal_strings(WIDTH)
    doc = corpus.doc[place]
    best = np.full(string.max(initial=-1) + 1, 2**63 - 1)
    np.minimum.at(best, string, least[again][doc])
    at[begin[again][doc] + place - corpus.start[doc]] = best[string]
    return at, begin


def removed_spans(data: list[bytes], own: np.ndarray, got: list, n: int) -> list[list[tuple[int, int]]]:
    """Merged byte spans of each row that go."""
    parse = Parse(data, own)
    parse.told(got, n)
    runs = Runs(parse, got, n)
    bits = gathered([m for m in got if m[0] >= 2 * n], 0, np.uint64)
    # Strings that go, by phrase: all of a run that the part has under a smaller id, else as told.
    step = np.arange(runs.count.sum()) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count)
    on = (np.repeat(bits[runs.number], runs.count) >> step.astype(np.uint64)) & np.uint64(1) > 0
    on |= np.repeat(runs.least[runs.number] < parse.least[runs.phrase], runs.count)
    phrase, place = np.repeat(runs.phrase, runs.count)[on], (np.repeat(runs.at, runs.count) + step)[on]
    order = np.argsort(phrase, kind="stable")
    phrase, place = phrase[order], place[order]
    whole = own[parse.row] > parse.least[parse.number]
    some = np.flatnonzero(~whole)
    from_, to = np.searchsorted(phrase, parse.number[some]), np.searchsorted(phrase, parse.number[some], side="right")
    times = to - from_
    which = np.repeat(from_, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    rows = np.concatenate([parse.row[whole], np.repeat(parse.row[some], times)])
    starts = np.concatenate([parse.at[whole], np.repeat(parse.at[some], times) + place[which]])
    sizes = np.concatenate([parse.count[whole] + WIDTH - 1, np.full(len(which), WIDTH)])
    return covered([len(x) for x in data], rows, starts, starts + sizes)


def covered(sizes: list[int], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[tuple[int, int]]]:
    """Merged spans of each text, by counting at every byte how many spans are open (a gap keeps texts apart)."""
    base = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + 1)])
    open_ = np.bincount(base[row] + start, minlength=base[-1] + 1)
    open_ -= np.bincount(base[row] + end, minlength=base[-1] + 1)
    on = np.concatenate([[False], np.cumsum(open_) > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    owner = np.searchsorted(base, edge[::2], side="right") - 1
    for r, s, e in zip(owner.tolist(), (edge[::2] - base[owner]).tolist(), (edge[1::2] - base[owner]).tolist()):
        out[r].append((s, e))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _plan(docs: DataFrame, id_col: str, text_col: str, part_bytes: int, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """(dealt documents, messages that tell each part what goes, number of parts)."""
    dealt, n = deal(docs, id_col, text_col, part_bytes)
    mine = thin(dealt)
    owners = answer(send(mine, _announce_phrases(n)), _owners)
    known = owners.unionByName(answer(resend(mine, owners, _announce_keys(n)), _shared(n, hot)))
    return dealt, known.unionByName(answer(resend(mine, known, _send_runs(n)), _settle)), n


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """One row per input row: bytes, bytes removed, maximal removed runs, digest of what is kept."""
    dealt, messages, n = _plan(docs, id_col, text_col, part_bytes, hot)

    def fn(part: int, table: pa.Table, got: list) -> dict:
        data, spans = texts(table), []
        spans = removed_spans(data, ids(table), got, n)
        return {
            id_col: table.column("_id"),
            "n_bytes": [len(x) for x in data],
            "n_removed": [sum(e - s for s, e in x) for x in spans],
            "n_spans": [len(x) for x in spans],
            "kept_sha256": [hashlib.sha256(without(d, s)).hexdigest() for d, s in zip(data, spans)],
        }

    return finish(thin(dealt), messages, fn, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

