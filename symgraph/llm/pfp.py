"""Corpus order by prefix-free parsing: the suffix arrays of a dictionary and of a parse, combined.

Documents are cut into phrases by a rolling window of WINDOW bytes: where the window's hash is a trigger, a phrase
ends with that window and the next one begins with it.  The distinct phrases in lexicographic order are the
dictionary; the documents as series of phrase numbers are the parse.  A trigger never stands inside a phrase, so no
suffix of a phrase that is longer than the window is a proper prefix of another one, and two places in the documents
compare

* by the suffixes of their phrases, whose order is the suffix array of the dictionary, and if these are equal,
* by what follows, which is the order of the parse's suffixes after them.

Repeated text costs the dictionary nothing; the work per byte of the documents is two lookups and one sort.
A document's end is smaller than any byte.  Suffixes that are equal to their ends are in no particular order.
"""

from __future__ import annotations

import numpy as np

from .common import splitmix

WINDOW = 8
#: One window in so many is a trigger.
EVERY = 8
_32 = np.uint64(32)


def words(raw: bytes) -> np.ndarray:
    """The eight bytes at each place as a number (little-endian), without copying."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,)) if len(raw) > 7 else np.empty(0, "<u8")


def ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each key among the distinct keys in order, from 1, and how many there are."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    if len(keys):
        new[order] = np.cumsum(np.append(True, keys[order][1:] != keys[order][:-1]))
    return new, int(new.max(initial=0))


def doubled(rank: np.ndarray, last: np.ndarray, depth: int, longest: int) -> np.ndarray:
    """Ranks of suffixes from ranks of their first `depth` symbols; last: the place where each one's sequence ends."""
    here, many = np.arange(len(rank)), int(rank.max(initial=0))
    while depth < longest and many < len(rank):
        after = here + depth
        inside = after <= last
        follow = np.where(inside, rank[np.where(inside, after, 0)], 0)
        rank, many = ranks((rank.astype(np.uint64) << _32) | follow.astype(np.uint64))
        depth *= 2
    return rank


class Corpus:
    """Documents (bytes in a row), their parse, and the dictionary."""

    def __init__(self, docs: list[bytes]):
        self.raw = b"".join(docs)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        found = np.flatnonzero(splitmix(words(self.raw)) % np.uint64(EVERY) == 0)
        found = found[(found > self.start[self.doc[found]]) & (found + WINDOW <= self.end[self.doc[found]])]
        self.begin = np.sort(np.concatenate([self.start[sizes > 0], found]))
        owner = self.doc[self.begin] if len(self.begin) else np.empty(0, np.int64)
        self.final = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
        self.stop = np.where(self.final, self.end[owner], np.append(self.begin[1:], 0) + WINDOW)
        self._dictionary()

    def _dictionary(self) -> None:
        """phrase: number of each phrase of the parse; phrases: the distinct ones in order, a document's last ones first."""
        numbers: dict[tuple[bytes, bool], int] = {}
        seen = [numbers.setdefault((self.raw[s:e], not f), len(numbers)) for s, e, f in zip(self.begin.tolist(), self.stop.tolist(), self.final.tolist())]
        self.phrases = sorted(numbers)
        number = np.empty(len(numbers), np.int64)
        number[[numbers[p] for p in self.phrases]] = np.arange(len(numbers))
        self.phrase = number[np.asarray(seen, np.int64)]

    def dictionary_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the suffixes of all phrases in a row, where each phrase begins); equal suffixes have equal ranks."""
        sizes = np.fromiter((len(p) + 1 for p, _ in self.phrases), np.int64, len(self.phrases))
        last = np.cumsum(sizes) - 1
        symbols = np.zeros(sizes.sum(), np.uint64)
        where = np.ones(len(symbols), bool)
        where[last] = False
        symbols[where] = np.frombuffer(b"".join([p for p, _ in self.phrases]), np.uint8).astype(np.uint64) + np.uint64(2)
        symbols[last] = [goes_on for _, goes_on in self.phrases]  # a document's end is the smallest symbol
        ends, here, key = np.repeat(last, sizes), np.arange(len(symbols)), np.zeros(len(symbols), np.uint64)
        for j in range(7):
            inside = here + j <= ends
            key = (key << np.uint64(9)) | np.where(inside, symbols[np.where(inside, here + j, 0)], np.uint64(0))
        return doubled(ranks(key)[0], ends, 7, int(sizes.max(initial=0))), last + 1 - sizes

    def parse_ranks(self) -> np.ndarray:
        """Ranks of the parse's suffixes."""
        if not len(self.phrase):
            return self.phrase
        ends = np.flatnonzero(self.final)
        count = np.diff(np.append(-1, ends))
        return doubled(self.phrase + 1, np.repeat(ends, count), 1, int(count.max()))

    def order(self, places: np.ndarray | None = None) -> np.ndarray:
        """Places (all by default, or some in ascending order) in the order of what begins there."""
        places = np.arange(len(self.raw)) if places is None else places
        if not len(places):
            return places
        suffix, base = self.dictionary_ranks()
        follow = np.where(self.final, 0, np.append(self.parse_ranks()[1:], 0)).astype(np.uint64)
        at = np.searchsorted(self.begin, places, side="right") - 1
        first = suffix[base[self.phrase[at]] + places - self.begin[at]].astype(np.uint64)
        return places[np.argsort((first << _32) | follow[at], kind="stable")]

    def equal_strings(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places with at least `width` (8 or more) bytes left in their document, number of each one's string), in
        corpus order.  Neighbours in that order are compared byte by byte; equal strings are neighbours."""
        left = np.maximum(self.end - self.start - (width - 1), 0)
        order = self.order(np.repeat(self.start, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
        word, new = words(self.raw), np.zeros(max(0, len(order) - 1), bool)
        for j in [*range(0, width - 7, 8), width - 8]:
            part = word[order + j]
            new |= part[1:] != part[:-1]
        return order, np.cumsum(np.append(False, new)) if len(order) else order
