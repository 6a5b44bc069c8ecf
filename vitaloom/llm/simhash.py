"""SimHash near-duplicates by anchor-point covering.

Fingerprints within ``threshold`` differing bits share a stripe that differs in at most ``threshold //
stripes`` bits. The anchors of a stripe are the words of a covering code: Hamming (15, 11), of covering radius 1,
beside free bits. Each distinct fingerprint goes to every anchor within covering radius plus stripe threshold, so
linked fingerprints meet at an anchor. Per anchor, fingerprints are compared and joined to local groups; only a
star of links leaves, never the pairs of a group. Groups of anchors then join in :mod:`components`.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; fewer words than a shingle
holds make one shingle; texts of any length count whole; exact copies share one fingerprint, hence one component;
a document without id links others like any other and gets the least id of its component, null where none has one; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import materialize, texts_of
from vitaloom.llm.components import connected_components

#: Members of one anchor beyond which it is searched by bands instead of by one matrix.
MATRIX = 512


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, in order; of all words where they are fewer; none for a blank text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at the six ASCII blanks
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        begins = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[b:e], seed) for b, e in zip(begins, ends[shingle - 1 :], strict=False)]
    return np.array(hashes, "<u8")


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(h: np.ndarray) -> int:
    """A bit is 1 where it is set in over half the hashes; none give 0."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and ``fp``, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def _nearest_codeword(x: np.ndarray) -> np.ndarray:
    """Nearest word of the Hamming (15, 11) code to the low 15 bits; higher bits stay as they are."""
    syndrome = np.zeros(len(x), np.uint64)
    for k in range(15):
        syndrome ^= np.where((x >> np.uint64(k)) & np.uint64(1), np.uint64(k + 1), np.uint64(0))
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return x ^ flip


def anchors(fp: np.ndarray, threshold: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for every anchor within covering radius plus threshold, by stripe.

    ``threshold // 2`` + 1 stripes leave at most one differing bit in one of them.
    """
    stripes = threshold // 2 + 1
    edge = [64 * s // stripes for s in range(stripes + 1)]
    index, anchor = [], []
    for s in range(stripes):
        width = edge[s + 1] - edge[s]
        x = (fp >> np.uint64(edge[s])) & np.uint64((1 << width) - 1)
        reach = [_nearest_codeword(x)] + [_nearest_codeword(x ^ np.uint64(1 << k)) for k in range(width)]
        near = np.sort(np.stack(reach, axis=1), axis=1)
        fresh = np.concatenate((np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        i, j = np.nonzero(fresh)
        index.append(i)
        anchor.append(near[i, j] | np.uint64(s << 60))
    return np.concatenate(index), np.concatenate(anchor)


def local_groups(fp: np.ndarray, threshold: int) -> np.ndarray:
    """For each fingerprint the lowest index of its group of chained links. Memory stays linear in the members."""
    n = len(fp)
    root = np.arange(n)
    if n <= MATRIX:
        _sweep(fp, np.arange(n), threshold, root)
        return root
    bands = threshold + 1
    edge = [64 * b // bands for b in range(bands + 1)]
    parent = np.arange(n)
    for b in range(bands):  # linked fingerprints are equal in one of threshold + 1 bands
        key = (fp >> np.uint64(edge[b])) & np.uint64((1 << (edge[b + 1] - edge[b])) - 1)
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cut):
            if len(part) > 1:
                own = np.arange(n)
                _sweep(fp[part], part, threshold, own)
                for a, z in zip(part.tolist(), own[part].tolist(), strict=True):
                    _unite(parent, a, z)
    return np.array([_find(parent, i) for i in range(n)])


def _sweep(fp: np.ndarray, names: np.ndarray, threshold: int, root: np.ndarray) -> None:
    """Breadth-first search of chained links: each member is compared once with all that are still alone."""
    left = np.arange(len(fp))
    while len(left):
        queue, members = [left[0]], [left[0]]
        left = left[1:]
        while queue and len(left):
            hit = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= threshold
            found = left[hit]
            left = left[~hit]
            queue += found.tolist()
            members += found.tolist()
        root[names[members]] = names[members].min()


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _unite(parent: np.ndarray, a: int, b: int) -> None:
    a, b = _find(parent, a), _find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def _links_of_sorted(anchor: np.ndarray, fp: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, head) of each run of equal anchors; small runs are compared side by side, all at once."""
    head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(head, len(anchor)))
    us, vs = [], []
    small = np.repeat(size <= 64, size)
    a, f, r = anchor[small], fp[small], rep[small]
    for shift in range(1, int(min(64, size.max(initial=0)))):
        same = a[shift:] == a[:-shift]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= threshold)
        if near.any():
            us.append(r[shift:][near])
            vs.append(r[:-shift][near])
    for b, n in zip(head[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        root = local_groups(fp[b : b + n], threshold)
        off = root != np.arange(n)
        us.append(rep[b : b + n][off])
        vs.append(rep[b : b + n][root[off]])
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    pair = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
    return pair[0], pair[1]


def near_links(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (u, v) between representatives ``rep`` of distinct fingerprints ``fp``; enough of them to join all chains."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column("fp").to_numpy(), b.column("rep").to_numpy()
            for k in range(0, len(fp), 20_000):
                i, anchor = anchors(fp[k : k + 20_000].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[k:][i]), pa.array(rep[k:][i])], names=["anchor", "fp", "rep"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] | None = None  # rows of the last anchor, which may go on in the next batch
        for b in batches:
            rows = [b[c].to_numpy() for c in ("anchor", "fp", "rep")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[last:] for x in rows]
            u, v = _links_of_sorted(rows[0][:last], rows[1][:last].view(np.uint64), rows[2][:last], threshold)
            yield pd.DataFrame({"u": u, "v": v})
        if held is not None:
            u, v = _links_of_sorted(held[0], held[1].view(np.uint64), held[2], threshold)
            yield pd.DataFrame({"u": u, "v": v})

    spread_out = distinct.select("fp", "rep").mapInArrow(spread, "anchor long, fp long, rep long")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(compare, "u long, v long").distinct()


def groups_of(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """fp, component for every row of ``distinct`` (fp): component is the least fingerprint reachable, as a signed long."""
    parts = connected_components(near_links(distinct.select("fp", F.col("fp").alias("rep")), threshold))
    return distinct.join(parts, distinct.fp == parts.node, "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every document."""
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member = groups_of(distinct, threshold)  # by fingerprint: ids may be null
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
