"""Near copies on word shingles: SimHash groups first, then all that are left by exact Jaccard similarity.

Rows with equal shingle sets are one class. :mod:`simhash` groups the fingerprints of the classes by anchors; a class whose set is as
similar as asked to that of its group's least id goes. This takes away most of a large group of near copies, in joins
that split. Fingerprints cannot say more: sets of Jaccard 0.8 differ in about 10 of 64 bits, a distance at which no covering code
is selective. So the classes left are joined exactly: a class can have a near copy only if others hold ``similarity`` % of its
shingles: shingles are counted by cut hashes in buckets of bounded size, and all other classes are sifted out. What is
left is ordered by the number of holders: two sets as similar as asked share a shingle among the first |A| - c + 1 of
each, c the least overlap (prefix filter). Classes that meet there form candidate groups; within a group sets are
compared exactly, breadth first, each with those that are still alone. No pairs leave a task.

What stays: no two rows as similar as asked, and for every row that went, a chain of such similarities to one that stays.

Defined results: blank and null texts are one class with an empty set, similar to no other; fewer words than a shingle
holds make one shingle; repeated rows are one class; an empty table gives an empty table. Shingles count as equal
when their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import discard, materialize, recorded
from vitaloom.llm.components import connected_components
from vitaloom.llm.simhash import fingerprint_of, groups_of, shingle_hashes

#: Shingles of one bucket of the sift, on average.
BUCKET = 1_000_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", shingle))


def class_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def with_class(docs: DataFrame, shingle: int) -> DataFrame:
    """row (all columns but the text), text, near_class (the name of the row's shingle set), near_size (the size of it), fp (SimHash of the shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, fps = [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t or "", shingle)
                own = np.unique(h)
                names.append(class_of(own))
                sizes.append(len(own))
                fps.append(fingerprint_of(h))
            extra = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=["row", "text", "near_class", "near_size", "fp"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    return rows.mapInArrow(run, rows.withColumns({c: F.lit(0).cast("long") for c in ("near_class", "near_size", "fp")}).schema)


def _as_fingerprints_say(rows: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """near_class of those classes that are as similar as asked to the class of the least id in their fingerprint's group."""
    id_ = F.col("row")["doc_id"].cast("long")
    classes = rows.groupBy("near_class").agg(F.min(F.struct(F.isnull(id_).alias("none"), id_.alias("id"))).alias("least"), F.min("fp").alias("fp"))
    grouped = materialize(classes.join(groups_of(classes.select("fp").distinct()), "fp").select("near_class", "least", "component"), "groups")
    heads = grouped.groupBy("component").agg(F.min(F.struct("least", "near_class")).alias("w"), F.count("*").alias("members"))
    heads = heads.where("members > 1").select("component", F.col("w.near_class").alias("head"))
    pairs = grouped.join(heads, "component").where("near_class != head").select("near_class", "head")
    wanted = pairs.select("near_class").union(pairs.select("head")).distinct()
    texts = materialize(rows.select("near_class", "text").join(wanted, "near_class", "left_semi").groupBy("near_class").agg(F.min("text").alias("text")), "texts")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, np.empty(0, np.uint64)
        for b in batches:
            keep = []
            for k, (h, ours, theirs) in enumerate(zip(b.column("head").to_pylist(), b.column("text").to_pylist(), b.column("head_text").to_pylist(), strict=True)):
                if h != last:
                    last, head = h, shingle_set(theirs, shingle)
                own = shingle_set(ours, shingle)
                both = len(np.intersect1d(own, head, assume_unique=True))
                if both and 100 * both >= similarity * (len(own) + len(head) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column("near_class").take(pa.array(keep, pa.int64()))], names=["near_class"])

    said = pairs.join(texts, "near_class").join(texts.select(F.col("near_class").alias("head"), F.col("text").alias("head_text")), "head")
    return said.select("near_class", "head", "text", "head_text").mapInArrow(alike, "near_class long")


def _likely(rows: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """near_class of all classes that share enough shingles with others, and of a few more (cut hashes may agree)."""
    total = rows.agg(F.sum("near_size")).first()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, total / BUCKET)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = {c: shingle_set(t, shingle) for c, t in zip(b.column("near_class").to_pylist(), b.column("text").to_pylist(), strict=True)}
            names, size = np.array(list(sets), np.int64), [len(s) for s in sets.values()]
            if not sum(size):
                continue
            all_, owner = np.concatenate(list(sets.values())), np.repeat(names, size)
            bucket = (all_ >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, short = bucket[order], owner[order], (all_[order] >> np.uint64(32 - bits)).astype(np.uint32)
            head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(head[1:], len(bucket))
            out = [[], [], []]
            for lo, hi in zip(head.tolist(), ends.tolist(), strict=True):
                first = np.flatnonzero(np.concatenate(([True], owner[lo + 1 : hi] != owner[lo : hi - 1])))
                for x, part in zip(out, (short[lo:hi], owner[lo:hi][first], np.diff(np.append(first, hi - lo)).astype(np.uint32)), strict=True):
                    x.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "short", "owners", "times"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        short = np.frombuffer(b"".join(pdf["short"]), np.uint32)
        owner = np.repeat(np.frombuffer(b"".join(pdf["owners"]), np.int64), np.frombuffer(b"".join(pdf["times"]), np.uint32))
        order = np.lexsort((owner, short))
        short, owner = short[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        ends = np.append(head[1:], len(short))
        common = np.repeat(owner[head] != owner[ends - 1], ends - head)  # held by two classes at least
        names, times = np.unique(owner[common], return_counts=True)
        return pd.DataFrame({"near_class": names, "shared": times})

    dealt = rows.select("near_class", "text").mapInArrow(deal, "bucket long, short binary, owners binary, times binary")
    shared = dealt.groupBy("bucket").applyInPandas(count, "near_class long, shared long").groupBy("near_class").agg(F.sum("shared").alias("shared"))
    sizes = rows.select("near_class", "near_size").distinct()
    return shared.join(sizes, "near_class").where(100 * F.col("shared") >= similarity * F.col("near_size")).select("near_class")


def similar_groups(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """For each set the index of the first of its group of chained similar ones."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(sets)), size)
    by_token = np.argsort(flat, kind="stable")
    token, holder = flat[by_token], owner[by_token]
    root, queue, alone, held = np.full(len(sets), -1), [], len(sets), len(sets)
    first = 0
    while alone or queue:
        if not alone:
            break
        if not queue:
            while root[first] >= 0:
                first += 1
            root[first], alone = first, alone - 1
            queue = [first]
        if 2 * alone < held:  # forget the holders that have a group
            left = root[holder] < 0
            token, holder, held = token[left], holder[left], alone
        j = queue.pop()
        own = flat[at[j] : at[j + 1]]
        lo = np.searchsorted(token, own)
        n = np.searchsorted(token, own, side="right") - lo
        hit = holder[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        who, both = np.unique(hit, return_counts=True)
        near = who[(root[who] < 0) & (100 * both >= similarity * (size[j] + size[who] - both))]
        root[near] = root[j]
        alone -= len(near)
        queue += near.tolist()
    return root


def near_copies(rows: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """near_class, head for each class of ``rows`` (:func:`with_class`) that has a near copy: chained by Jaccard >= similarity %."""
    likely = materialize(_likely(rows, shingle, similarity), "likely")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t, shingle).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("near_class"), sets], names=["near_class", "tokens"])

    one = rows.select("near_class", "text").join(likely, "near_class", "left_semi").groupBy("near_class").agg(F.min("text").alias("text"))
    sets = materialize(one.mapInArrow(run, "near_class long, tokens array<long>"), "sets")
    token = sets.select("near_class", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    holders = token.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    ordered = token.join(holders, "token").groupBy("near_class", "size").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("shared"))
    least = F.ceil(F.col("size") * similarity / 100.0 - 1e-9).cast("int")
    spare = F.size("shared") - least + 1  # shingles of the class alone come first in the order and cannot meet
    prefix = ordered.where(spare > 0).select("near_class", F.explode(F.slice("shared", F.lit(1), spare)).alias("s")).select("near_class", F.col("s.token").alias("token"))
    heads = F.min("near_class").over(Window.partitionBy("token"))
    links = prefix.withColumn("v", heads).where("v < near_class").select(F.col("near_class").alias("u"), "v").distinct()
    parts = connected_components(links)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("near_class")
        names = pdf["near_class"].to_numpy()
        head = names[similar_groups([np.asarray(t) for t in pdf["tokens"]], similarity)]
        return pd.DataFrame({"near_class": names, "head": head})

    joined = sets.join(parts, sets.near_class == parts.node).select("component", "near_class", "tokens")
    return joined.groupBy("component").applyInPandas(solve, "near_class long, head long")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id; a row without id only where its group has no other."""
    rows = materialize(with_class(docs, shingle), "classes")
    with recorded() as passing:
        gone = materialize(_as_fingerprints_say(rows, shingle, similarity), "gone")
        left = rows.join(gone, "near_class", "left_anti")
        heads = materialize(near_copies(left, shingle, similarity), "heads")
    discard(*(t for t in passing if t is not gone and t is not heads))
    group = F.coalesce("head", "near_class")
    id_ = F.col("row")["doc_id"].cast("long")
    key = F.coalesce(id_.cast("string"), F.lit("none")).alias("near_key")
    slim = left.select("near_class", id_.alias("id"), key).distinct().join(heads, "near_class", "left")
    won = slim.groupBy(group.alias("near_group")).agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "near_class", "near_key")).alias("w"))
    keyed = left.select("near_class", key, "row", "text").join(won.select("w.near_class", "w.near_key"), ["near_class", "near_key"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("near_class", "near_key").orderBy("text", F.xxhash64("row")))
    return keyed.withColumn("near_rank", rank).where("near_rank = 1").select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
