"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document is cut at every multiple of the sequence length; only its last piece is shorter, and these are what
must be packed. Spark counts them in a histogram of length classes (at most ``length / grain`` numbers, whatever
the corpus). On that histogram the driver solves the cutting-stock linear program: columns are patterns of
classes that fill one sequence, priced by an unbounded-knapsack dynamic program. Rounded-down pattern counts plus
first-fit-decreasing patterns for the rest give slots; Spark ranks the pieces of a class in parallel and joins
rank to slot. No piece and no document passes through the driver.

Defined results: a null text counts as empty, an empty document is its end id alone (one piece of length 1), a
document of any length is cut into full pieces and a rest, repeated rows are packed as often as they occur, extra
columns are ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import materialize, texts_of
from vitaloom.llm.wordids import word_ids

PIECE_SCHEMA = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids with the checksum of each; ``ids`` too (binary, 32 bit) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = word_ids(tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple] = []
            for doc, copy, ids in zip(b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), enc.encode_texts(b.column("text").to_pylist()), strict=True):
                raw = np.concatenate((ids, end)).tobytes()
                n = len(raw) // 4
                for s in range(0, n, length):
                    part = raw[4 * s : 4 * (s + length)]
                    rows.append((doc, copy, s, len(part) // 4, zlib.crc32(part), n, *([part] if keep_ids else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * (6 + keep_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(c, pa.binary()) for c in cols[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    texts = texts_of(docs).withColumn("copy", F.monotonically_increasing_id())
    return texts.select("doc_id", "copy", "text").mapInArrow(run, PIECE_SCHEMA + ", ids binary" * keep_ids)


def _knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best unbounded filling of ``capacity`` by dynamic programming: its value and the count of each item."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = int(np.searchsorted(weight, c, "right"))
        if fits:
            v = best[c - weight[:fits]] + value[:fits]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], take[c] = v[k], k
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[int(take[c])] = out.get(int(take[c]), 0) + 1
            c -= int(weight[take[c]])
    return float(best[capacity]), out


def cutting_stock(demand: dict[int, int], capacity: int, rounds: int = 2000, tolerance: float = 2e-3) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) patterns that hold every item of ``demand`` {size: count} exactly once.

    Column generation on the linear relaxation, started from the patterns of one size each; counts are rounded
    down and what is left goes into first-fit-decreasing patterns.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    patterns: list[dict[int, int]] = [{k: int(capacity // sizes[k])} for k in range(m)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = (inverse * need).sum(axis=1)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        gain, column = _knapsack(np.maximum(dual, 0), sizes, capacity)
        if gain <= 1 + tolerance:  # the relaxation is within that share of its optimum (dual bound)
            break
        a = np.zeros(m)
        a[list(column)] = list(column.values())
        d = (inverse * a).sum(axis=1)  # no BLAS: its threads would fight the JVM's
        up = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        leave = int(np.argmin(ratio))
        patterns[leave] = column
        row = inverse[leave] / d[leave]
        inverse -= np.outer(d, row)
        inverse[leave] = row
        x = x - d * ratio[leave]
        x[leave] = ratio[leave]
    left = {int(s): int(n) for s, n in zip(sizes, need, strict=True)}
    out = []
    for p, times in zip(patterns, np.floor(x + 1e-6).astype(int).tolist(), strict=True):
        times = min([times, *(left[int(sizes[k])] // n for k, n in p.items())])
        if times > 0:
            out.append((times, {int(sizes[k]): n for k, n in p.items()}))
            for k, n in p.items():
                left[int(sizes[k])] -= times * n
    while any(left.values()):
        room, pattern = capacity, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            if n := min(room // s, left[s]):
                pattern[s], room = n, room - n * s
        times = min(left[s] // n for s, n in pattern.items())
        out.append((times, pattern))
        for s, n in pattern.items():
            left[s] -= times * n
    return out


def pack(pieces: DataFrame, length: int, grain: int = 8, shares: int = 64, share_rows: int = 200_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``length`` tokens.

    Classes are lengths rounded up to ``grain``. Ranks within a class are counted in ``shares`` independent shares, more
    where these would hold over ``share_rows`` pieces, and shifted by the shares' running totals, so that no class,
    however common, meets in one task. The driver sees a count a class and one a share.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    shares_of = [(r["size"], max(shares, math.ceil(r["n"] / share_rows))) for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()]
    shares_of = spark.createDataFrame(shares_of, "size int, salts int")
    pieces = pieces.join(F.broadcast(shares_of), "size").withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.col("salts")).cast("int")).drop("salts")
    counted = sorted((r["size"], r["salt"], r["n"]) for r in pieces.groupBy("size", "salt").agg(F.count("*").alias("n")).collect())
    demand: dict[int, int] = {}
    before = []
    for size, salt, n in counted:
        before.append((size, salt, demand.get(size, 0)))
        demand[size] = demand.get(size, 0) + n
    slots, sequence, used = [], 0, dict.fromkeys(demand, 0)
    for times, pattern in cutting_stock(demand, length // grain):
        for size, n in pattern.items():
            slots.append((size, used[size], used[size] + times * n, n, sequence))
            used[size] += times * n
        sequence += times
    base = spark.createDataFrame(before, "size int, salt int, before long")
    slot = spark.createDataFrame(slots, "slot_size int, lo long, hi long, each int, first long")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "copy", "start")) - 1)
    ranked = ranked.join(F.broadcast(base), ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slot), (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "copy", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, grain: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length % grain:
        raise ValueError("grain must divide length")
    pieces = materialize(token_pieces(docs, tokenizer_path, length, end_id), "pieces")
    return pack(pieces, length, grain).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
