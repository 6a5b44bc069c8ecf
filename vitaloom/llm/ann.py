"""Approximate nearest neighbours by balanced posting lists.

*Index.* Largest inner product becomes least angle by one more component, sqrt(M² - |x|²) with M the largest norm. A bounded
sample (``sample_rows``) is split in halves, each time at the median along the line between two means, so that all lists are
equally large, about ``list_rows`` vectors whatever their number; the directions of their means are the centroids (at most
``max_lists``, sent to all tasks with the links of the graph that is searched). Every vector goes to its nearest list and, as a
boundary vector, to up to ``replicas`` lists whose centroid is at most ``1 + slack`` times as far and not hidden behind one taken.
*Search.* A query visits the lists whose distance lies within a ratio of the way from its nearest list's distance to its mean
distance from all lists, however many these are (plain distances differ too little in many dimensions to tell lists apart). The ratio is
fitted: the neighbours of ``trials`` queries are found by brute force, and it is the least one at which their lists hold ``recall``
of them. Centroids are found by best-first search on the graph with a beam that grows until it reaches beyond the ratio.
Neighbouring lists form blocks of counted size, and blocks and their visitors are cut into shares, so that a common vector or a
popular list does not meet in one task. A query is scored against each vector of the lists it visits once, in the first block that holds it, however many of the lists the vector is in. Scores
are sums in double precision over the components in order, on the original vectors.

Without clusters no list tells much of where neighbours are; then lists are visited until the recall holds, and the work stays a
fraction of brute force that shrinks with the number of lists but not to a constant.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows without id are left out; equal scores go to the smaller id; a row that repeats an id counts once, with its largest score; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import materialize

LIST_ROWS = 10
MAX_LISTS = 16_384
SAMPLE_ROWS = 40_000
#: Vectors, and visitors, of a block that meet in one task.
SHARE_ROWS, SHARE_VISITS = 16_000, 4_000
#: A list is hidden from a vector if its centroid's squared distance to that of a list taken is under this share of that to the vector.
HIDDEN = 0.5
#: Centroids that the search keeps open at first.
BEAM = 64
#: Blocks of neighbouring lists, and vectors of one where there are more: a query sends its vector and gets its best once a block and share, so blocks are few.
BLOCKS, BLOCK_ROWS = 8, 100_000


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>): the vectors that take part."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = df.where(F.col(id_col).isNotNull() & v.isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    common = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    dims = common.first()
    return ok.where(F.size("v") == (dims["d"] if dims else 0))


def balanced_leaves(x: np.ndarray, leaves: int, seed: int = 5) -> np.ndarray:
    """Means of ``leaves`` equally large parts of x (a power of two)."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < leaves:
        parts = [half for p in parts for half in _halves(x, p, rng)]
    return np.stack([x[p].mean(axis=0) for p in parts])


def _halves(x: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    own = x[part]
    a, b = own[rng.choice(len(own), 2, replace=False)] if len(own) > 1 else (own[0], own[0])
    for _ in range(6):
        side = own @ (a - b)
        near = side > np.median(side)
        if near.all() or not near.any():
            break
        a, b = own[near].mean(axis=0), own[~near].mean(axis=0)
    order = np.argsort(own @ (a - b), kind="stable")
    mid = len(part) // 2
    return part[order[:mid]], part[order[mid:]]


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def graph_links(c: np.ndarray, degree: int = 24) -> np.ndarray:
    """For each centroid its nearest ones and some spread ones, a row each, in order and filled up with itself."""
    n = len(c)
    links: list[set[int]] = [set() for _ in range(n)]
    for s in range(0, n, 1024):
        d = -(c[s : s + 1024] @ c.T)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near = np.argpartition(d, min(degree, n - 1), axis=1)[:, :degree] if n > 1 else np.zeros((len(d), 0), int)
        for v, row in enumerate(near.tolist(), s):
            links[v].update(row)
            for u in row[:8]:  # a centroid far from all others is no one's neighbour: it is linked back
                links[u].add(v)
    for v in range(n):
        links[v].update(((v + 1) % n, (v + max(1, n // 2)) % n))  # a ring keeps the graph in one piece
        links[v].discard(v)
    width = max(1, max(map(len, links)))
    return np.array([[*sorted(x), *[v] * (width - len(x))] for v, x in enumerate(links)])


class CentroidGraph:
    """Best-first search over a graph that links each centroid to its nearest ones and to some spread ones."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.sq = (self.c * self.c).sum(axis=1)
        self.links = links

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of centroids, one of each side."""
        x = self.c[a] - self.c[b]
        return (x * x).sum(axis=-1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the ``beam`` nearest found, nearest first, for each row of q."""
        q = np.ascontiguousarray(q, np.float32)
        m, n = len(q), len(self.c)
        beam = min(beam, n)
        qq = (q * q).sum(axis=1)
        if 8 * beam >= n:  # a walk that long costs more than all distances
            d = qq[:, None] + self.sq - 2 * q @ self.c.T
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(d, order, 1)
        rows = np.arange(m)
        entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
        seen = np.zeros((m, n), bool)
        seen[:, entry] = True
        best_d = np.full((m, beam + len(entry)), np.inf, np.float32)
        best_c = np.zeros((m, beam + len(entry)), np.int64)
        opened = np.ones((m, beam + len(entry)), bool)
        best_d[:, : len(entry)] = qq[:, None] + self.sq[entry] - 2 * q @ self.c[entry].T
        best_c[:, : len(entry)], opened[:, : len(entry)] = entry, False
        order = np.argsort(best_d, axis=1, kind="stable")[:, :beam]
        best_d, best_c, opened = (np.take_along_axis(x, order, 1) for x in (best_d, best_c, opened))
        while True:
            todo = np.where(opened, np.inf, best_d)
            at = todo.argmin(axis=1)
            live = np.isfinite(todo[rows, at])
            if not live.any():
                return best_c, best_d
            r = rows[live]
            opened[r, at[live]] = True
            next_ = self.links[best_c[r, at[live]]]
            fresh = ~seen[r[:, None], next_]
            fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            seen[r[:, None], next_] = True
            d = qq[r, None] + self.sq[next_] - 2 * np.einsum("ijk,ik->ij", self.c[next_], q[r])
            d = np.where(fresh, d, np.inf).astype(np.float32)
            all_d = np.concatenate((best_d[r], d), axis=1)
            all_c = np.concatenate((best_c[r], next_), axis=1)
            all_o = np.concatenate((opened[r], ~fresh), axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            best_d[r], best_c[r], opened[r] = (np.take_along_axis(x, keep, 1) for x in (all_d, all_c, all_o))


def closure(graph: CentroidGraph, found: np.ndarray, d: np.ndarray, slack: float, replicas: int) -> np.ndarray:
    """Which of the lists found a vector belongs to: the nearest, and near ones not hidden behind one taken, up to ``replicas``."""
    take = np.zeros(found.shape, bool)
    take[:, 0] = True
    d = np.maximum(d, 0)
    for k in range(1, min(4 * replicas, found.shape[1])):
        near = d[:, k] <= (1 + slack) ** 2 * d[:, 0]
        behind = np.zeros(len(found), bool)
        for j in range(k):
            behind |= take[:, j] & (graph.between(found[:, k], found[:, j]) < HIDDEN * d[:, k])
        take[:, k] = near & ~behind
    return take & (np.cumsum(take, axis=1) <= replicas)


def way_out(d: np.ndarray, least: np.ndarray, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Where each distance lies between the nearest list (0) and the root mean square over all lists (1); d and least are squared."""
    near = np.sqrt(np.maximum(least, 0))[:, None]
    far = np.sqrt(np.maximum(2 - 2 * x @ mean, 0))[:, None]
    return (np.sqrt(np.maximum(d, 0)) - near) / np.maximum(far - near, 1e-6)


class Index(NamedTuple):
    """postings and visits (of the queries): block, id, v, lists of that block, others (see ``build``). centroids: unit vectors. ratio: bound of :func:`way_out`. blocks: how many."""

    postings: DataFrame
    visits: DataFrame
    centroids: np.ndarray
    ratio: float
    blocks: int


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(len(b), -1)


def _top(qid: np.ndarray, qv: np.ndarray, pid: np.ndarray, pv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of query, id, score) of the k best distinct ids of each query; pid is sorted, pv has a row for each component."""
    head = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1])))
    total = np.zeros((len(qid), pv.shape[1]))
    for j in range(len(pv)):
        total += qv[:, j, None] * pv[j]
    if len(head) < total.shape[1]:  # the largest score of an id that has several vectors
        total = np.maximum.reduceat(total, head, axis=1)
    pid = pid[head]
    total[qid[:, None] == pid] = -np.inf
    last = max(0, len(pid) - k)
    least = np.partition(total, last, axis=1)[:, last]
    i, j = np.nonzero((total >= least[:, None]) & np.isfinite(total))
    order = np.lexsort((pid[j], -total[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[rank < k], j[rank < k]
    return i, pid[j], total[i, j]


def _fitted_ratio(vectors: DataFrame, postings: DataFrame, qid: np.ndarray, qv: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> float:
    """The least ratio at which the lists within it hold ``recall`` of the true neighbours of these queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ids, v = _matrix(b)
                order = np.argsort(ids, kind="stable")
                i, near, score = _top(qid, qv, ids[order], v[order].T, k)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(near), pa.array(score)], names=["q", "id", "score"])

    scored = vectors.mapInArrow(run, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    held = postings.select("id", F.explode("lists").alias("list")).join(F.broadcast(best.select("q", "id")), "id").distinct().collect()  # at most trials x k ids and the lists of each
    x = unit(np.concatenate((qv, np.zeros((len(qv), 1))), axis=1))
    d = 2 - 2 * x @ centroids.T
    way = way_out(d, d.min(axis=1), x, centroids.mean(axis=0))
    ratio: dict[tuple[int, int], float] = {}
    for r in held:
        ratio[r["q"], r["id"]] = min(way[r["q"], r["list"]], ratio.get((r["q"], r["id"]), np.inf))
    seen = sorted(ratio.values())
    return float(seen[min(len(seen), math.ceil(recall * len(seen))) - 1]) + 1e-6 if seen else 1.0


def build(vectors: DataFrame, k: int, query_mod: int, recall: float, trials: int, slack: float, replicas: int, sample_rows: int, list_rows: int, max_lists: int) -> Index:
    """Index all rows of ``vectors`` (id, v) and find the lists that each query visits."""
    spark = vectors.sparkSession
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top = vectors.agg(F.count("*"), F.max(norm2)).first()
    leaves = 1 << max(0, min(int(math.log2(max_lists)), round(math.log2(max(1, n / list_rows)))))
    share = min(1.0, sample_rows / n)
    chosen = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))) if share < 1 else vectors

    def widen(v: np.ndarray) -> np.ndarray:
        return np.concatenate((v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]), axis=1) / math.sqrt(top)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=pdf["v"].map(tuple)).sort_values(["id", "t"])
        c = unit(balanced_leaves(widen(np.stack(pdf["v"].to_numpy())), min(leaves, 1 << int(math.log2(len(pdf))))))
        return pd.DataFrame({"c": list(c)})

    if share < 1 and not chosen.head(1):
        chosen = vectors.limit(1000)
    centroids = np.array([r["c"] for r in chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "c array<double>").collect()])
    blocks = min(len(centroids), max(BLOCKS, n // BLOCK_ROWS))
    shared = spark.sparkContext.broadcast((centroids, graph_links(centroids)))  # at most max_lists rows

    def graph() -> CentroidGraph:
        if _GRAPHS.get("key") is not shared.value:
            _GRAPHS.update(key=shared.value, graph=CentroidGraph(*shared.value))
        return _GRAPHS["graph"]

    def rows_of(b: pa.RecordBatch, found: np.ndarray, take: np.ndarray, asking: bool) -> pa.RecordBatch:
        """A row for each vector and block: its lists there, and as ``others`` a bit for every list it visits if it asks, else its lists in blocks before."""
        i, j = np.nonzero(take)
        lists = found[i, j]
        order = np.lexsort((lists, i))
        i, lists = i[order], lists[order]
        block = lists * blocks // len(centroids)
        head = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (block[1:] != block[:-1]))))
        part, ends = b.take(pa.array(i[head])), pa.array(np.append(head, len(i)), pa.int32())
        if asking:
            visited = np.zeros((len(b), len(centroids)), bool)
            visited[i, lists] = True
            bits = [row.tobytes() for row in np.packbits(visited, axis=1)]
            others = [bits[k] for k in i[head].tolist()]
        else:
            first = np.searchsorted(i, i[head])
            others = [lists[f:h].astype("<i4").tobytes() for f, h in zip(first.tolist(), head.tolist(), strict=True)]
        columns = [pa.array(block[head]), part.column("id"), part.column("v"), pa.ListArray.from_arrays(ends, pa.array(lists)), pa.array(others, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "id", "v", "lists", "others"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph()
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                found, d = g.search(widen(_matrix(part)[1]), BEAM)
                yield rows_of(part, found, closure(g, found, d, slack, replicas), False)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, mean = graph(), centroids.mean(axis=0)
        for b in batches:
            for s in range(0, len(b), 500):
                part, beam = b.slice(s, 500), BEAM
                v = _matrix(part)[1]
                x = unit(np.concatenate((v, np.zeros((len(v), 1))), axis=1))
                while True:
                    found, d = g.search(x, beam)
                    within = way_out(d, d[:, 0], x, mean) <= ratio
                    if beam >= len(g.c) or not within[:, -1].any():
                        break
                    beam *= 4
                held = sizes[found]
                yield rows_of(part, found, within | (np.cumsum(held, axis=1) - held < 5 * k * replicas), True)  # however near the first list is, enough are seen

    schema = "block long, id long, v array<double>, lists array<long>, others binary"
    postings = materialize(vectors.mapInArrow(post, schema), "postings")
    sizes = np.zeros(len(centroids), np.int64)
    counted = postings.select("id", F.explode("lists").alias("list")).groupBy("list").agg(F.count_distinct("id").alias("ids")).collect()  # at most max_lists rows
    sizes[[r["list"] for r in counted]] = [r["ids"] for r in counted]
    asked = vectors.where(F.col("id") % query_mod == 0)
    tried = asked.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(trials).collect()
    ratio = _fitted_ratio(vectors, postings, np.array([r["id"] for r in tried]), np.array([r["v"] for r in tried]), centroids, k, recall) if len(centroids) > 1 and tried else 1.0
    return Index(postings, materialize(asked.mapInArrow(visit, schema), "visits"), centroids, ratio, blocks)


def search(index: Index, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the visits of an index."""
    spark = index.postings.sparkSession
    # shares of a block and of its visitors, from counts, a row a block
    parts = {r["block"]: max(1, math.ceil(r["count"] / SHARE_ROWS)) for r in index.postings.groupBy("block").count().collect()}
    turns = {r["block"]: max(1, math.ceil(r["count"] / SHARE_VISITS)) for r in index.visits.groupBy("block").count().collect()}
    grid = spark.createDataFrame([(c, parts[c], turns.get(c, 0)) for c in sorted(parts)], "block long, parts int, turns int")
    cell = F.broadcast(grid)
    salt = lambda by: F.pmod(F.xxhash64("id", F.lit(3)), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    right = index.postings.join(cell, "block").where("turns > 0").withColumn("part", salt("parts")).withColumn("turn", each("turns")).drop("parts", "turns")
    left = index.visits.join(cell, "block").withColumn("turn", salt("turns")).withColumn("part", each("parts")).drop("parts", "turns")

    def score(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        who, what, values = [], [], []
        if len(q) and len(p):
            p = p.sort_values("id", kind="stable")  # places of vectors are then in order of id
            place = np.repeat(np.arange(len(p)), p["lists"].map(len).to_numpy())
            lists = np.concatenate(p["lists"].to_numpy())
            order = np.argsort(lists, kind="stable")
            lists, place = lists[order], place[order]
            pid, pv = p["id"].to_numpy(), np.stack(p["v"].to_numpy())
            earlier = [np.frombuffer(x, "<i4") for x in p["others"]]
            before = np.full((len(p), max(1, max(map(len, earlier)))), -1)  # the last bit of a query's, which is none of a list
            for k_, x in enumerate(earlier):
                before[k_, : len(x)] = x
            for qid, qv, own, bits in zip(q["id"].tolist(), q["v"], q["lists"], q["others"], strict=True):
                begin, end = np.searchsorted(lists, own), np.searchsorted(lists, own, side="right")
                seen = np.unique(np.concatenate([place[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]))
                visited = np.append(np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), False)
                seen = seen[~visited[before[seen]].any(axis=1)]  # those that a block before has scored for this query
                if len(seen):
                    _, ids, value = _top(np.array([qid]), np.asarray(qv)[None], pid[seen], np.ascontiguousarray(pv[seen].T), k)
                    who.append(np.full(len(ids), qid))
                    what.append(ids)
                    values.append(value)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        found = pd.DataFrame({"query_id": join(who, np.int64), "vec_id": join(what, np.int64), "score": join(values, float)})
        found = found.groupby(["query_id", "vec_id"], as_index=False)["score"].max()  # ids that are asked for twice
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found[found.groupby("query_id").cumcount() < k]

    keys = ("block", "part", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, query_mod: int = 20, recall: float = 0.93, trials: int = 256, slack: float = 0.3, replicas: int = 4, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query (ids divisible by ``query_mod``)."""
    vectors = materialize(valid_vectors(df, id_col, vec_col).distinct(), "vectors")
    if not vectors.head(1):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(build(vectors, k, query_mod, recall, trials, slack, replicas, sample_rows, list_rows, max_lists), k)


_GRAPHS: dict = {}
