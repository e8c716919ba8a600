"""Vector codes by product quantisation: integer Lloyd rounds with the filtering algorithm over kd-trees.

A vector's components become integers floor(1024 x) and are cut into PARTS equal parts, each position with a codebook of
ENTRIES entries.  Every partition turns its vectors, BLOCK at a time, into one kd-tree a position: points in tree order,
and for each node the bounding box, the sum and the number of its points.  The trees are written once to the shared
folder; every round reads them and sends a codebook down them, level by level, with all nodes of a level in one array
operation.  At a node the entry nearest to the box's middle rules out each entry that is farther at the corner of the box
that favours it most (or as far, with a higher index: ties go to the lower).  A node with one entry left gives that entry
its whole sum and count; what is left at a leaf is compared point by point.  Partitions send one row an entry, sums are
added by Spark, and the driver gets PARTS * ENTRIES rows a round, whatever the number of vectors.  The last pass assigns
subtrees in the same way and writes codes and errors.

All arithmetic is in integers, so results depend neither on the order of sums nor on how vectors are dealt.

Rows whose vector is null or holds nulls, NaN or infinities are dropped, as are rows whose vector has another length than
that of the smallest kept id.  Repeated rows and equal ids all stay; where ids are equal the smaller vector comes first in
the starting codebook, and null ids come last.  Fewer vectors than ENTRIES make smaller codebooks, an empty table gives an
empty result.  A length that is no multiple of PARTS, or components so large that their squares leave 62 bits, is an
error.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, shared_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one tree, and points of a leaf.
BLOCK, LEAF = 1 << 15, 16
#: Pairs of node and entry that are compared at once.
PAIRS = 1 << 17
#: Groups into which each label is split where its error is joined back to the rows.
SALTS = 64


# Trees


def grow(points: np.ndarray) -> dict[str, np.ndarray]:
    """A kd-tree: `order`, `points` in that order, and for every level the nodes' `starts`, boxes, sums and counts.

    Each node is halved along its box's longest side; all nodes of a level at once.
    """
    n, dim = points.shape
    depth = max(0, int(np.log2(max(n, 1) / LEAF))) if n else 0
    order, starts, tree = np.arange(n, dtype=np.int32), np.zeros(1, np.int64), {}
    for level in range(depth + 1):
        p = points[order]
        count = np.diff(np.append(starts, n))
        low, high, total = (f.reduceat(p, starts, axis=0) if dim else np.zeros((len(starts), 0), np.int64) for f in (np.minimum, np.maximum, np.add))
        tree |= {f"s{level}": starts, f"l{level}": low, f"h{level}": high, f"t{level}": total}
        if level < depth:
            node = np.repeat(np.arange(len(starts)), count)
            side = np.argmax(high - low, axis=1)[node] if dim else np.zeros(n, np.int64)
            key = p[np.arange(n), side] if dim else np.zeros(n, np.int64)
            order = order[np.lexsort((key, node))]
            starts = np.stack([starts, starts + count // 2], axis=1).reshape(-1)
    return tree | {"order": order, "points": points[order]}


def levels(tree: dict[str, np.ndarray]) -> int:
    return sum(k[0] == "s" for k in tree)


def descend(tree: dict[str, np.ndarray], book: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(sums, counts) of the points nearest to every entry of a codebook, and, where `each`, the entry of every point.

    Pairs (node, entry) are kept in order of node, then entry.
    """
    n, k, last = len(tree["points"]), len(book), levels(tree) - 1
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(k, np.int64)
    owner = np.full(n, -1, np.int32) if each else None
    exact, node, entry = Exact(tree, book), np.zeros(k, np.int64), np.arange(k)
    for level in range(last + 1):
        starts, total = tree[f"s{level}"], tree[f"t{level}"]
        ends = np.append(starts[1:], n)
        stay = exact.stay(level, node, entry)
        node, entry = node[stay], entry[stay]
        first = _firsts(node)
        size = np.diff(np.append(first, len(node)))
        alone = size == 1
        whole, by = node[first[alone]], entry[first[alone]]
        np.add.at(sums, by, total[whole])
        np.add.at(counts, by, ends[whole] - starts[whole])
        if each:
            for i, j, e in zip(starts[whole].tolist(), ends[whole].tolist(), by.tolist()):
                owner[i:j] = e
        left = np.repeat(~alone, size)
        node, entry, size = node[left], entry[left], size[~alone]
        if not len(node):
            break
        if level < last:
            at = np.append(0, np.cumsum(size)).tolist()
            # The two children of a node follow each other, each with all of its entries.
            twice = np.concatenate([np.r_[i:j, i:j] for i, j in zip(at[:-1], at[1:])])
            half = np.repeat(np.tile([0, 1], len(size)), np.repeat(size, 2))
            node, entry = 2 * node[twice] + half, entry[twice]
        else:
            found = exact.nearest(node, entry, starts, ends)
            some = np.flatnonzero(found >= 0)
            some = some[np.argsort(found[some], kind="stable")]
            cuts = _firsts(found[some])
            sums[found[some[cuts]]] += np.add.reduceat(tree["points"][some], cuts, axis=0)
            counts += np.bincount(found[some], minlength=k)
            if each:
                owner[some] = found[some]
    return sums, counts, owner


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


class Exact:
    """Comparisons of a codebook with a tree's boxes and points: in floats where all numbers are exact there, else in
    64-bit integers."""

    def __init__(self, tree: dict[str, np.ndarray], book: np.ndarray):
        largest = int(max(np.abs(tree["points"]).max(initial=0), np.abs(book).max(initial=0)))
        self.kind = np.float64 if 16 * max(book.shape[1], 1) * largest**2 < 1 << 52 else np.int64
        self.tree, self.book = tree, book.astype(self.kind)
        self.square = (self.book * self.book).sum(axis=1)
        self.apart = np.abs(self.book[:, None, :] - self.book[None, :, :])

    def stay(self, level: int, node: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which pairs may still hold a nearest entry of some point in the node's box."""
        low, high = (self.tree[f"{x}{level}"].astype(self.kind) for x in "lh")
        middle, width = low + high, high - low
        first = _firsts(node)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        away = self.square[entry] - (self.book @ middle.T)[entry, node]  # from the middle, less what all entries share
        near = np.flatnonzero(away == np.minimum.reduceat(away, first)[of])
        best = near[_firsts(of[near])]
        star = entry[best][of]
        # At the corner that favours an entry most: |z|^2 - |s|^2 - 2 corner.(z - s)
        more = away - away[best][of]
        for i in range(0, len(node), PAIRS):
            j = i + PAIRS
            more[i:j] -= np.einsum("ij,ij->i", self.apart[entry[i:j], star[i:j]], width[node[i:j]])
        return (more < 0) | ((more == 0) & (entry <= star))

    def nearest(self, node: np.ndarray, entry: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The nearest entry of each point in the leaves of the pairs, by |z|^2 - 2 p.z; -1 for other points."""
        points, found = 2 * self.tree["points"].astype(self.kind), np.full(len(self.tree["points"]), -1, np.int32)
        first = _firsts(node)
        for i, j, s, e in zip(first.tolist(), np.append(first[1:], len(node)).tolist(), starts[node[first]].tolist(), ends[node[first]].tolist()):
            some = entry[i:j]
            found[s:e] = some[np.argmin(self.square[some] - points[s:e] @ self.book[some].T, axis=1)]
        return found


def moved(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries as floors of means; those without points stay."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)


# On Spark


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: _narrow(v) for k, v in arrays.items()})
    return out.getvalue()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
    return x.astype(kind)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k].astype(np.int64) for k in z.files}


def integers(flat: np.ndarray) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows with a vector of finite components; ids, labels and vectors only."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, odd))


def _grow_blocks(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition: ids, labels and one tree for each part."""
    held, rows = [], 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points = integers(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(rows, -1)
        trees = [_pack(grow(p)) for p in np.split(points, PARTS, axis=1)]
        cols = [pa.array([table.column(c).to_pylist()], out.field(c).type) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array([t], pa.binary()) for t in trees]], schema=out)

    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, BLOCK - rows), batch.slice(BLOCK - rows)
            held.append(part)
            rows += part.num_rows
            if rows == BLOCK:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def _round(blocks: DataFrame, books: np.ndarray) -> list[np.ndarray]:
    """New codebooks: each partition adds up its trees, Spark adds up the partitions."""
    width = books.shape[2]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for q in range(PARTS):
                for raw in batch.column(f"tree{q}"):
                    s, c, _ = descend(_unpack(raw.as_py()), books[q], each=False)
                    sums[q] += s
                    counts[q] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], schema=schema)

    sent = blocks.select(*[f"tree{q}" for q in range(PARTS)]).mapInArrow(run, "part int, entry int, n long, s array<long>")
    added = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for r in added.collect():  # PARTS * ENTRIES rows at most
        sums[r["part"], r["entry"]], counts[r["part"], r["entry"]] = r["s"], r["n"]
    return np.stack([moved(books[q], sums[q], counts[q]) for q in range(PARTS)])


def _assign(blocks: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    out = pa_schema(blocks.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in ("id", "label"))
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for q in range(PARTS):
                    tree = _unpack(batch.column(f"tree{q}")[i].as_py())
                    _, _, owner = descend(tree, books[q], each=True)
                    codes[tree["order"], q] = owner
                    error[tree["order"]] += ((tree["points"] - books[q][owner]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                for at in range(0, len(ids), 4096):
                    end = at + 4096
                    yield pa.RecordBatch.from_arrays([ids[at:end], labels[at:end], pa.array(code[at:end], pa.string()), pa.array(error[at:end])], schema=out)

    return blocks.mapInArrow(run, schema)


def learn(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame | None, np.ndarray | None]:
    """(written blocks of trees, final codebooks of shape part, entry, component), or nothing for an empty table."""
    spark = vectors.sparkSession
    rows = kept(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")), "v")
    start = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(1).first()
    if start is None:
        return None, None
    dim = len(start["v"])
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("v") == dim)
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    if 4 * max(dim, 1) * (largest * SCALE + 1) ** 2 >= 2**62:
        raise ValueError(f"components up to {largest} are too large for integer distances")
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).collect()
    books = np.stack(np.split(integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim)), PARTS, axis=1))
    kinds = dict(rows.dtypes)
    schema = f"id array<{kinds['id']}>, label array<{kinds['label']}>, " + ", ".join(f"tree{q} binary" for q in range(PARTS))
    out, folder = pa_schema(spark, schema), f"{shared_path(spark)}/codes-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda batches: _grow_blocks(batches, out), schema).write.parquet(f"{folder}/trees")
    blocks = spark.read.schema(schema).parquet(f"{folder}/trees")
    for _ in range(ROUNDS):
        books = _round(blocks, books)
    return blocks, books


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector.

    label_error adds up the errors of a label, nulls together.  A label that a third of the rows have is summed in parts
    before the shuffle, and joined back in SALTS groups.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    blocks, books = learn(vectors, id_col, vec_col, label_col)
    names = "`{}` {}, code string, error long, label_error long, codebooks_sha256 string"
    if blocks is None:
        return spark.createDataFrame([], names.format(id_col, kinds[id_col]))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    folder = f"{shared_path(spark)}/codes-{uuid.uuid4().hex}"
    schema = f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"
    _assign(blocks, books, schema).write.parquet(f"{folder}/codes")
    codes = spark.read.schema(schema).parquet(f"{folder}/codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (salted["salt"] == totals["salt"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
