"""Exchange of key arrays between parts of the documents and buckets of keys.

Operators that compare all documents by hashed keys would shuffle one row per key and position.  Here the
documents are dealt into parts of about PART_BYTES of text by a hash of the row; each part, in one Python
call, turns its texts into sorted numpy arrays and sends every bucket of the key space one message of raw
arrays (`dest`, `src`, up to three binaries).  A bucket merges what it got and answers the parts, again
with arrays.  Parts meet their answers by cogrouping on the part number, so texts are shuffled once
(Spark reuses that exchange in every later pass of the plan).

Nothing is collected to the driver but the total size of the texts, which sets the number of parts.  What a
part or bucket holds is bounded: parts by PART_BYTES (or one text), buckets by the number of keys over the
number of parts, because a part sends each key once however often it holds it.  A key that all documents
share thus costs a bucket one entry per part, not one per document.  Rows that are equal in id and text fall into
one part; copies under different ids do not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, text_bytes

PART_BYTES = 8 << 20
MESSAGE = "dest int, src int, a binary, b binary, c binary"
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def deal(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """The documents as `_part`, `_id` (long), `_text` and `_row` (the other columns), and the number of parts."""
    n = max(1, math.ceil(text_bytes(docs, text_col) / part_bytes))
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    return docs.select(part.alias("_part"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), rest.alias("_row")), n


def thin(dealt: DataFrame) -> DataFrame:
    return dealt.select("_part", "_id", "_text")


def texts(table: pa.Table) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table.column("_text").to_pylist()]


def ids(table: pa.Table) -> np.ndarray:
    """Ids as int64; a null id counts as larger than any other."""
    return table.column("_id").combine_chunks().fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)


def address(keys: np.ndarray, n: int) -> np.ndarray:
    """floor(key * n / 2^32): the bucket in the high half, the place within it in the low half; order is kept."""
    n64 = np.uint64(n)
    return (keys >> _32) * n64 + (((keys & _LOW) * n64) >> _32)


def low(addresses: np.ndarray) -> np.ndarray:
    return (addresses & _LOW).astype(np.uint32)


def joined(bucket: int, lows: np.ndarray) -> np.ndarray:
    return (np.uint64(bucket) << _32) | lows.astype(np.uint64)


def pack(x: np.ndarray) -> bytes:
    """An array's bytes by place value, so that the shuffle's compression finds the equal high bytes of sorted keys."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


class Outbox:
    """Messages of one sender."""

    def __init__(self, src: int):
        self.src, self.rows = src, {"dest": [], "src": [], "a": [], "b": [], "c": []}

    def put(self, dest: int, a: np.ndarray | None, b: np.ndarray | None = None, c: np.ndarray | None = None) -> None:
        for k, v in zip(("dest", "src", "a", "b", "c"), (dest, self.src, *(None if x is None else pack(x) for x in (a, b, c)))):
            self.rows[k].append(v)

    def forward(self, dest: int, got: list) -> None:
        """Pass on what was got, with its senders."""
        for m in got:
            for k, v in zip(("dest", "src", "a", "b", "c"), (dest, *m)):
                self.rows[k].append(v)

    def scatter(self, n: int, buckets_sorted: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, c: np.ndarray | None = None) -> None:
        """Cut arrays that are ordered by bucket and put each piece that isn't empty."""
        if not len(a):
            return
        cuts = np.flatnonzero(np.append(True, buckets_sorted[1:] != buckets_sorted[:-1]))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
            self.put(int(buckets_sorted[s]), a[s:e], None if b is None else b[s:e], None if c is None else c[s:e])

    def table(self) -> pa.Table:
        kinds = {"dest": pa.int32(), "src": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in self.rows.items()})


def inbox(table: pa.Table) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(sender, a, b, c) by sender."""
    cols = [table.column(k).to_pylist() for k in ("src", "a", "b", "c")]
    yield from sorted(zip(*cols), key=lambda x: x[0])


def send(dealt: DataFrame, fn: Callable[[int, pa.Table, Outbox], None]) -> DataFrame:
    """Messages of every part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = Outbox(key[0].as_py())
        fn(out.src, table, out)
        return out.table()

    return dealt.groupBy("_part").applyInArrow(run, MESSAGE)


def answer(messages: DataFrame, fn: Callable[[int, list, Outbox], None]) -> DataFrame:
    """What buckets (or parts) send after they got all their messages."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = Outbox(key[0].as_py())
        fn(out.src, list(inbox(table)), out)
        return out.table()

    return messages.groupBy("dest").applyInArrow(run, MESSAGE)


def resend(dealt: DataFrame, messages: DataFrame, fn: Callable[[int, pa.Table, list, Outbox], None]) -> DataFrame:
    """Messages of every part after it got its own."""

    def run(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        out = Outbox(key[0].as_py())
        if table.num_rows:
            fn(out.src, table, list(inbox(got)), out)
        return out.table()

    return dealt.groupBy("_part").cogroup(messages.groupBy("dest")).applyInArrow(run, MESSAGE)


def finish(dealt: DataFrame, messages: DataFrame, fn: Callable[[int, pa.Table, list], dict], schema: str) -> DataFrame:
    """Rows of every part after it got its messages; fn gives columns."""
    out = pa_schema(dealt.sparkSession, schema)

    def run(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        cols = fn(key[0].as_py(), table, list(inbox(got)))
        return pa.table([c if isinstance(c := cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in out], schema=out)

    return dealt.groupBy("_part").cogroup(messages.groupBy("dest")).applyInArrow(run, schema)


def gathered(got: list, which: int, kind) -> np.ndarray:
    """One array of all messages' a (0), b (1) or c (2), in the order of the senders."""
    return np.concatenate([unpack(m[1 + which], kind) for m in got]) if got else np.empty(0, kind)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys
