"""Resampling towards a target distribution: hashed-feature weights, Gumbel noise, exact ranks of the highest scores.

*Features.* Words are runs of ASCII digits, letters (A-Z lowered) and all characters beyond ASCII; features are runs of 1 to ``n`` words joined by a
blank; a feature's bucket is its crc32 modulo ``buckets``. The buckets of every text are written once, as small unsigned numbers.
*Weights.* Bucket counts of the corpus and of the target are summed in each task before they are shuffled, so no more than ``buckets`` rows
leave a task; the gain of every bucket is one array of fixed size that goes to all tasks, and a text's weight is the sum of the
array at its buckets. *Ranks.* Scores are integers. Their exact histogram (one row a score and block of ids) is sorted by range; sums of
the counts of the rows before, in the driver over ranges and in a window within each, say how many documents rank before each row. The
score at which the draw ends follows; only documents from it on are numbered, by id within each score and block, so that no score
meets in one task however many documents have it.

Defined results: a null text has no features; a document without features weighs 0; equal scores go to the smaller id, rows that repeat an id to
fewer features, then less weight; a row without id has no score and is never drawn, but its features count; extra columns are ignored; an empty table
gives an empty table, an empty target no features. Rows that repeat one id are numbered in one task, which sorts them with spilling.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import discard, materialize

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into words at a time, so that a long text never lies in memory as a list of all its words.
PIECE = 1 << 20
#: Ids of one block: 2 to this power.
BLOCK_BITS = 20


def _word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    low, at = raw.translate(_FOLD), 0
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def hashed_features(raw: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a UTF-8 text and the bucket of every feature."""
    words, out, tail = 0, [np.empty(0, np.uint32)], []
    for piece in _word_pieces(raw):
        known, words = len(tail), words + len(piece)
        piece = tail + piece
        crc = list(map(zlib.crc32, piece))
        out.append(np.array(crc[known:], np.uint32))
        for k in range(1, n):  # features of k + 1 words end k words later; those that end in the tail were counted before
            crc = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(crc, piece[k:])]
            out.append(np.array(crc[max(known - k, 0) :], np.uint32))
        tail = piece[len(piece) - n + 1 :] if n > 1 else []
    return words, np.concatenate(out) % buckets


def features(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary, unsigned little-endian numbers of 2 bytes, or 4 beyond 65 536 buckets)."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [hashed_features(t.as_buffer().to_pybytes() if t.is_valid else b"", n, buckets) for t in b.column("text")]
            columns = [b.column("doc_id"), pa.array([w for w, _ in made], pa.int64()), pa.array([len(f) for _, f in made], pa.int64()), pa.array([f.astype(kind).tobytes() for _, f in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(ids.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(column: pa.Array, buckets: int) -> np.ndarray:
    """The values of a binary column, end to end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, "<u2" if buckets <= 1 << 16 else "<u4", (at[-1] - at[0]) // (2 if buckets <= 1 << 16 else 4), at[0]) if raw is not None and len(at) > 1 else np.empty(0, np.uint16)


def bucket_counts(made: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: counted in the tasks, ``buckets`` numbers at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column("buckets"), buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in made.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target and corpus) for each bucket."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of gains over each text's features."""
    size = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column("n_features").to_numpy()
            sums = np.concatenate(([0], np.cumsum(gain[_numbers(b.column("buckets"), size)])))
            ends = np.cumsum(counts)
            weight = pa.array(sums[ends] - sums[ends - counts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), weight], names=["doc_id", "n_words", "n_features", "weight"])

    return made.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, min_words: int = 20, percent: int = 10) -> DataFrame:
    """``scored`` (a written table with doc_id, n_words, score) with ``rank``: exact places of the highest scores, null for the rest."""
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    block = F.shiftright("doc_id", BLOCK_BITS)
    number = scored.where(able).count() * percent // 100
    none = F.lit(None).cast("long")
    if not number:
        return scored.withColumn("rank", none)
    histogram = scored.where(able).groupBy("score", block.alias("block")).agg(F.count("*").alias("n"))
    ranges = materialize(histogram.repartitionByRange(F.desc("score"), F.asc("block")).withColumn("range", F.spark_partition_id()), "scores")
    # one row a range, as many as shuffle partitions
    base, first = 0, {}
    for r in ranges.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        first[r["range"]] = base
        base += r["n"]
        if base >= number:
            break
    at = scored.sparkSession.createDataFrame(list(first.items()), "range int, base long")
    order = Window.partitionBy("range").orderBy(F.desc("score"), "block")
    before = F.col("base") + F.sum("n").over(order) - F.col("n")
    places = ranges.where(F.col("range") <= max(first)).join(at, "range").select("score", "block", before.alias("before")).where(F.col("before") < number)
    places = materialize(places, "places")
    discard(ranges)
    cutoff = places.agg(F.min("score")).first()[0]
    drawn = able & (F.col("score") >= cutoff)
    ranked = scored.where(drawn).withColumn("block", block).join(places, ["score", "block"], "left")
    within = Window.partitionBy("score", "block").orderBy("doc_id", "n_features", "weight")
    place = F.col("before") + F.row_number().over(within)
    ranked = ranked.withColumn("rank", F.when(place <= number, place).cast("long")).select(*scored.columns, "rank")
    return ranked.union(scored.where(~drawn).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of ``docs``; ``target`` has a column ``text``."""
    made = materialize(features(docs, n=n, buckets=buckets), "features")
    gain = gains(bucket_counts(made, buckets), bucket_counts(features(target, id_col=None, n=n, buckets=buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(made, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    discard(made)
    return draw(scored, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
