"""Vector codes from codebooks of vector parts, trained by Lloyd rounds on heaps.

A vector's components become integers, floor(scale * x), and the vector is cut into equal parts; each part position has a codebook of
``entries`` entries. Everything is exact in 64-bit integers: distances, sums, and means rounded down.

*State.* Kept vectors lie in blocks of at most ``BLOCK_ROWS``, one row a block of a written table, so a task holds one block at a time. For each part
position and entry a block has a heap of its parts, keyed by the slack between the bounds of the second nearest and the nearest entry
(lower minus upper) plus the drift that the entry had gathered when the bounds were taken. *Round.* New entries come from the blocks' sums, added up
by Spark: one row an entry and component reaches the driver. An entry's drift grows by its own move and the largest move of any other. From each heap only
parts whose key lies below the drift are popped: their bounds may be violated. They are measured exactly against all entries and pushed onto the
heap of the nearest one. All others keep their entry without a look at their components. Keys are rounded down and drifts up, so rounding can
only cost a needless measurement.

Defined results: vectors that are null, or hold null or non-finite components, or have another length than most (the shorter among equals) are left out; so
is an empty vector. Rows of fewer than ``entries`` vectors give codebooks of so many entries; equal distances go to the lower entry. First entries come from the smallest
ids, rows without id last; rows that repeat an id are ordered by their components. Every kept row is returned, repeated ids too; a row without id has a null
id. Extra columns are ignored; an empty table gives an empty table. A length that is no multiple of ``parts`` is an error, and
so is a component beyond ``LARGEST`` once scaled, where sums of squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import discard, materialize, records_per_batch

#: Vectors of one block; their places in it take two bytes.
BLOCK_ROWS = 8192
LARGEST = 1 << 27
_ROUNDING = 1e-9


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, v (array<double>), label of the vectors that take part."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.where(v.isNotNull() & whole & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    common = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("v") == (common["d"] if common else 0))


def measured(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the nearest entry (lower among equals), its squared distance and the slack to the second nearest."""
    d = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - book[:, j]
        d += step * step
    near = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = d[rows, near]
    d[rows, near] = np.iinfo(np.int64).max
    upper, lower = np.sqrt(best.astype(float)), np.sqrt(d.min(axis=1).astype(float))
    return near, best, lower - upper - _ROUNDING * (lower + upper)


def _down(keys: np.ndarray) -> np.ndarray:
    return np.nextafter(keys.astype(np.float32), np.float32(-np.inf))


class Block:
    """Vectors of one block and their heaps: for part p and entry j the next ``sizes[p, j]`` places of ``keys[p]`` and ``rows[p]``."""

    def __init__(self, ids: pa.Array, labels: pa.Array, x: np.ndarray, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        self.ids, self.labels, self.x, self.keys, self.rows, self.sizes = ids, labels, x, keys, rows, sizes
        self.looked = 0

    @classmethod
    def first(cls, ids: pa.Array, labels: pa.Array, x: np.ndarray, books: np.ndarray) -> Block:
        """Every part measured; sorted keys are heaps."""
        parts, entries, width = books.shape
        n = len(x)
        keys, rows, sizes = np.empty((parts, n), np.float32), np.empty((parts, n), np.uint16), np.zeros((parts, entries), np.int32)
        for p in range(parts):
            near, _, slack = measured(x[:, p * width : (p + 1) * width].astype(np.int64), books[p])
            key = _down(slack)
            order = np.lexsort((key, near))
            keys[p], rows[p], sizes[p] = key[order], order, np.bincount(near, minlength=entries)
        out = cls(ids, labels, x, keys, rows, sizes)
        out.looked = n * parts
        return out

    def advance(self, books: np.ndarray, drift: np.ndarray) -> None:
        """Pop what the drift may have moved, measure it, push it onto the heap of its nearest entry."""
        parts, entries, width = books.shape
        for p in range(parts):
            ends = np.cumsum(self.sizes[p])
            begins = ends - self.sizes[p]
            heaps: dict[int, list[tuple[float, int]]] = {}

            def heap(j: int) -> list[tuple[float, int]]:
                if j not in heaps:
                    span = slice(begins[j], ends[j])
                    heaps[j] = list(zip(self.keys[p, span].tolist(), self.rows[p, span].tolist(), strict=True))
                return heaps[j]

            popped: list[int] = []
            for j in np.flatnonzero(self.sizes[p]).tolist():
                due = float(drift[p, j])
                if self.keys[p, begins[j]] > due:
                    continue
                own = heap(j)
                while own and own[0][0] <= due:
                    popped.append(heappop(own)[1])
            if not popped:
                continue
            self.looked += len(popped)
            at = np.array(popped)
            near, _, slack = measured(self.x[at, p * width : (p + 1) * width].astype(np.int64), books[p])
            key = _down(slack + drift[p, near])
            for item in zip(near.tolist(), key.tolist(), popped, strict=True):
                heappush(heap(item[0]), item[1:])
            keys, rows = [], []
            for j in range(entries):
                if j in heaps:
                    keys.append(np.array([k for k, _ in heaps[j]], np.float32))
                    rows.append(np.array([r for _, r in heaps[j]], np.uint16))
                    self.sizes[p, j] = len(heaps[j])
                else:
                    keys.append(self.keys[p, begins[j] : ends[j]].copy())
                    rows.append(self.rows[p, begins[j] : ends[j]].copy())
            self.keys[p], self.rows[p] = np.concatenate(keys), np.concatenate(rows)

    def nearest(self) -> np.ndarray:
        """Entry of every vector's parts."""
        parts, entries = self.sizes.shape
        out = np.empty((len(self.x), parts), np.uint8 if entries <= 256 else np.uint16)
        for p in range(parts):
            out[self.rows[p], p] = np.repeat(np.arange(entries), self.sizes[p])
        return out

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Parts an entry, and sums an entry and component (exact: a block's sums stay far below 2 to the 53)."""
        parts, entries = self.sizes.shape
        width = self.x.shape[1] // parts
        near, sums = self.nearest(), np.zeros((parts, entries, width), np.int64)
        for p in range(parts):
            for j in range(width):
                sums[p, :, j] = np.bincount(near[:, p], weights=self.x[:, p * width + j], minlength=entries)
        return self.sizes.astype(np.int64), sums

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to its entries."""
        parts, _, width = books.shape
        near, out = self.nearest(), np.zeros(len(self.x), np.int64)
        for p in range(parts):
            step = self.x[:, p * width : (p + 1) * width].astype(np.int64) - books[p][near[:, p]]
            out += (step * step).sum(axis=1)
        return out

    def row(self) -> pa.RecordBatch:
        counts, sums = self.totals()
        small = np.int16 if not len(self.x) or np.abs(self.x).max() < 1 << 15 else np.int32
        cells = [self.ids, self.labels, self.x.astype(small).tobytes(), np.dtype(small).itemsize, self.keys.tobytes(), self.rows.tobytes(), self.sizes.tobytes(), counts.ravel(), sums.ravel(), self.looked]
        kinds = [pa.list_(self.ids.type), pa.list_(self.labels.type), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([_one(c, k) for c, k in zip(cells, kinds, strict=True)], names=_NAMES)

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int, parts: int, entries: int) -> Block:
        cell = lambda name: batch.column(name)[k].as_py()
        ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
        x = np.frombuffer(cell("x"), np.int16 if cell("bytes") == 2 else np.int32).reshape(len(ids), -1)
        shaped = lambda name, kind: np.frombuffer(cell(name), kind).reshape(parts, -1).copy()
        return cls(ids, labels, x, shaped("keys", np.float32), shaped("rows", np.uint16), shaped("sizes", np.int32).reshape(parts, entries))


_NAMES = ["ids", "labels", "x", "bytes", "keys", "rows", "sizes", "counts", "sums", "looked"]


def _one(cell: object, kind: pa.DataType) -> pa.Array:
    """A column of one cell."""
    if not pa.types.is_list(kind):
        return pa.array([cell], kind)
    values = cell if isinstance(cell, pa.Array) else pa.array(cell, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _schema(label: str) -> str:
    return f"ids array<long>, labels array<{label}>, x binary, bytes int, keys binary, rows binary, sizes binary, counts array<long>, sums array<long>, looked long"


def _scaled(flat: np.ndarray, d: int, scale: int) -> np.ndarray:
    x = np.floor(scale * flat.astype(float))
    if len(x) and np.abs(x).max() >= LARGEST:
        raise OverflowError(f"a component beyond {LARGEST // scale} has no exact 64-bit distance")
    return x.astype(np.int32).reshape(-1, d)


def first_blocks(kept: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """Blocks of all vectors with every part measured against the first entries."""
    d = books.shape[0] * books.shape[2]

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, labels, v = (t.column(c).combine_chunks() for c in ("vec_id", "label", "v"))
        return Block.first(ids, labels, _scaled(v.flatten().to_numpy(zero_copy_only=False), d, scale), books).row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            while len(b):
                part = b.slice(0, BLOCK_ROWS - size)
                held.append(part)
                size += len(part)
                b = b.slice(len(part))
                if size == BLOCK_ROWS:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return kept.mapInArrow(run, _schema(kept.schema["label"].dataType.simpleString()))


def advanced_blocks(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                block = Block.of(b, k, parts, entries)
                block.advance(books, drift)
                yield block.row()

    return blocks.mapInArrow(run, blocks.schema)


def moved_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Means of all parts rounded down; an entry without parts stays. Sums of blocks are added by Spark, one row an entry and component comes back."""
    parts, entries, width = books.shape
    total = lambda name, n: np.array([r[1] for r in blocks.select(F.posexplode(name).alias("at", "n")).groupBy("at").agg(F.sum("n")).orderBy("at").collect()] or [0] * n, np.int64)
    counts, sums = total("counts", parts * entries).reshape(parts, entries, 1), total("sums", books.size).reshape(books.shape)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry and the farthest of the others moved, rounded up."""
    move = np.sqrt(((new - old).astype(float) ** 2).sum(axis=2))
    others = np.zeros_like(move)
    if move.shape[1] > 1:
        top = np.sort(move, axis=1)[:, -2:]
        farthest = move.argmax(axis=1)[:, None] == np.arange(move.shape[1])
        others = np.where(farthest, top[:, :1], top[:, 1:])
    return (move + others) * (1 + _ROUNDING)


def coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, entries, _ = books.shape
    digits = 2 if entries <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                block = Block.of(b, k, parts, entries)
                near = block.nearest()
                text = near.astype(near.dtype.newbyteorder(">")).tobytes().hex()
                wide = parts * digits
                codes = pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string())
                yield pa.RecordBatch.from_arrays([block.ids, block.labels, codes, pa.array(block.errors(books), pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of all vectors (vec_id, label, code, error), the final codebooks, and how many parts each assignment measured."""
    kept = kept_vectors(df, id_col, vec_col, label_col)
    label = kept.schema["label"].dataType.simpleString()
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not seeds:
        return df.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((parts, 0, 0), np.int64), []
    d = len(seeds[0]["v"])
    if d % parts:
        raise ValueError(f"vectors of {d} components cannot be cut into {parts} equal parts")
    first = _scaled(np.array([r["v"] for r in seeds]).ravel(), d, scale).astype(np.int64)
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, d // parts).swapaxes(0, 1))
    drift, looked = np.zeros(books.shape[:2]), []
    blocks = materialize(first_blocks(kept, books, scale), "blocks")
    with records_per_batch(df.sparkSession, 1):  # a row is a whole block
        for _ in range(rounds):
            looked.append(blocks.agg(F.sum("looked")).first()[0])
            moved = moved_books(blocks, books)
            drift, books = drift + drifted(books, moved), moved
            after = materialize(advanced_blocks(blocks, books, drift), "blocks")
            discard(blocks)
            blocks = after
        looked.append(blocks.agg(F.sum("looked")).first()[0])
        out = materialize(coded(blocks, books, label), "codes")
        discard(blocks)
    return out, books, looked


def code_digests(df: DataFrame, **options: object) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    out, books, _ = compress(df, **options)
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = out.alias("o").join(sums.alias("s"), F.col("o.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
