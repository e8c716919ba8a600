"""Line dedup: overlapping windows of three consecutive lines, of which later occurrences are removed.

Lines are the pieces between newlines; those without a word (blank ones) take no part and always stay.  Ends
of lines are stripped of ASCII white space before comparison.  Each three consecutive lines are hashed to
128 bits; over all documents the first occurrence of a window is that with the smallest (id, position,
hash of the text), and every later one covers its three lines.  Covered positions merge; their lines are removed.

Each part of the documents sends every window once, with its own first occurrence; buckets of the hash
space answer with first occurrences elsewhere (see `exchange`).  A window that all documents share costs a
bucket one entry per part.

Null and empty texts and texts of fewer than three lines have no window and stay as they are.  A null id
counts as larger than any other.  Rows with the same id and text are the same document: neither is later;
of different texts with the same id (or none), the 64-bit hash of the text says which is first.
Windows that overlap their own first occurrence (runs of equal lines) keep the lines before the overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .exchange import PART_BYTES, Outbox, address, answer, deal, finish, gathered, ids, send, texts, thin

SPAN = 3
_SPACE = b" \t\n\x0b\x0c\r"
_32 = np.uint64(32)
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])
_AT = np.dtype([("at", "<i4"), ("tie", "<u8")])


def windows(raw: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """(lines, numbers of the lines with a word, digests of the windows over these)."""
    lines = raw.split(b"\n")
    bare = [x.strip(_SPACE) for x in lines]
    used = [i for i, x in enumerate(bare) if x]
    text = [bare[i] for i in used]
    digest = xxhash.xxh3_128_digest
    return lines, used, [digest(b"\n".join(text[i : i + SPAN])) for i in range(len(text) - SPAN + 1)]


def _occurrences(data: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, position and hash of the text, row) of all windows of a part, ordered by key, id, position, hash."""
    digests, rows, places = [], [], []
    for row, raw in enumerate(data):
        found = windows(raw)[2]
        digests += found
        rows += [row] * len(found)
        places += range(len(found))
    key = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    row, at = np.asarray(rows, np.int64), np.empty(len(rows), _AT)
    at["at"], at["tie"] = places, np.asarray([xxhash.xxh3_64_intdigest(x) for x in data], np.uint64)[row]
    owner = own[row] if len(row) else np.empty(0, np.int64)
    order = np.lexsort((at["tie"], at["at"], owner, key[:, 1], key[:, 0]))
    return key[order], owner[order], at[order], row[order]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.empty(0, np.int64)


def _announce(n: int):
    def fn(part: int, table: pa.Table, out: Outbox) -> None:
        key, owner, at, _ = _occurrences(texts(table), ids(table))
        first = _starts(key)
        sent = np.empty(len(first), _KEY)
        sent["hi"], sent["lo"] = key[first, 0], key[first, 1]
        out.scatter(n, address(key[first, 0], n) >> _32, sent, owner[first], at[first])

    return fn


def _first(bucket: int, got: list, out: Outbox) -> None:
    """Tell each part which of its windows occur earlier in another."""
    sent, owner, at = gathered(got, 0, _KEY), gathered(got, 1, np.int64), gathered(got, 2, _AT)
    order = np.lexsort((at["tie"], at["at"], owner, sent["lo"], sent["hi"]))
    key = np.stack([sent["hi"][order], sent["lo"][order]], axis=1)
    first = _starts(key)
    group = np.empty(len(sent), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sent))))
    best_owner, best_at = owner[order][first][group], at[order][first][group]
    earlier = (best_owner != owner) | (best_at != at)
    s = 0
    for m in got:
        e = s + len(m[1]) // _KEY.itemsize
        mine = np.flatnonzero(earlier[s:e]) + s
        if len(mine):
            out.put(m[0], sent[mine], best_owner[mine], best_at[mine])
        s = e


def removed_lines(data: list[bytes], own: np.ndarray, got: list) -> list[set[int]]:
    """Numbers of the lines of each row that go."""
    key, owner, at, row = _occurrences(data, own)
    first = _starts(key)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    best_owner, best_at = owner[first].copy(), at[first].copy()
    told = gathered(got, 0, _KEY)
    if len(told):
        mine = np.empty(len(first), _KEY)
        mine["hi"], mine["lo"] = key[first, 0], key[first, 1]
        place = {k: i for i, k in enumerate(mine.tolist())}
        where = np.asarray([place[k] for k in told.tolist()])
        best_owner[where], best_at[where] = gathered(got, 1, np.int64), gathered(got, 2, _AT)
    later = np.flatnonzero((owner != best_owner[group]) | (at != best_at[group])) if len(key) else []
    out: list[set[int]] = [set() for _ in data]
    used: dict[int, list[int]] = {}
    for i in later:
        r = int(row[i])
        if r not in used:
            used[r] = windows(data[r])[1]
        p = int(at["at"][i])
        out[r].update(used[r][p : p + SPAN])
    return out


def _kept(raw: bytes, gone: set[int]) -> bytes:
    return b"\n".join([x for i, x in enumerate(raw.split(b"\n")) if i not in gone]) if gone else raw


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: lines, lines removed, digest of the text that is kept."""
    dealt, n = deal(docs, id_col, text_col, part_bytes)
    mine = thin(dealt)

    def fn(part: int, table: pa.Table, got: list) -> dict:
        data = texts(table)
        gone = removed_lines(data, ids(table), got)
        return {
            id_col: table.column("_id"),
            "n_lines": [len(d.split(b"\n")) if d else 0 for d in data],
            "n_removed": [len(g) for g in gone],
            "kept_sha256": [hashlib.sha256(_kept(d, g)).hexdigest() for d, g in zip(data, gone)],
        }

    return finish(mine, answer(send(mine, _announce(n)), _first), fn, f"{id_col} long, n_lines long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with all their columns and the repeated lines taken out of the text.

    A document that had words and lost all of them is dropped; one that never had any stays.
    """
    dealt, n = deal(docs, id_col, text_col, part_bytes)
    names = docs.columns

    def fn(part: int, table: pa.Table, got: list) -> dict:
        data = texts(table)
        gone = removed_lines(data, ids(table), got)
        text = [t if not g else _kept(d, g).decode("utf-8", "surrogatepass") for t, d, g in zip(table.column("_text").to_pylist(), data, gone)]
        keep = pa.array([not g or bool(t.strip(_SPACE.decode())) for t, g in zip(text, gone)], pa.bool_())
        rest = table.column("_row").combine_chunks()
        cols = {c: pa.array(text, pa.string()) if c == text_col else rest.field(c) for c in names}
        return {c: v.filter(keep) for c, v in cols.items()}

    mine = thin(dealt)
    schema = docs.schema
    return finish(dealt, answer(send(mine, _announce(n)), _first), fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
