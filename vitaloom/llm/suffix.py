"""Exact-substring dedup by prefix-free parsing: triggers, phrases, and two suffix orders that combine.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id goes.

* *Parsing.* A rolling hash over ``GRAM`` bytes sets triggers: the least hash among the gram starts of each
  ``length``-byte string. Equal strings hold the same trigger at the same place, so triggers cut all documents
  into the same phrases wherever they repeat.
* *Sifting.* Each share of documents sends the distinct trigger grams it holds, packed, to buckets by hash;
  a bucket tells a share which of its grams occur in another document as well. A string whose trigger gram
  occurs in one document only cannot repeat, and nothing more is sent for it.
* *Suffix orders.* For the others the dictionary (phrase ends before the trigger) and the parse (what follows it)
  go to the bucket of the gram, each distinct pair once a share. The bucket sorts what follows the triggers (suffix
  array of the parse) and what precedes them, read backwards (suffix array of phrase ends), takes longest common
  prefixes of neighbours, and so has for each depth the classes of equal contexts. The string that begins ``a``
  bytes before its trigger is the pair (class before at depth a, class after at depth length - a): equal pairs are
  one place in corpus order, and the least document among them owns it.
* *Cutting.* The shares get a bit mask a trigger, mark the covered bytes and cut them.

Whole copies of a text are settled first, by digest. Corpus order is built to depth ``length``, which is all that
the question needs.

Bounds: a share holds about ``SHARE_BYTES`` of text or one longer text, a bucket about as many grams as a share; a gram
that very many documents hold reaches its bucket once a share. Equal contexts do so too, but contexts that differ, as at
the borders of such a passage, come once a document. A long text is parsed in pieces of ``PASS_BYTES`` string starts.

Defined results: null texts count as empty, texts shorter than ``length`` lose nothing, rows without an id are left
out, rows that repeat an id do not cut each other, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom.llm.common import joined_with_hot_keys, materialize

GRAM = 20
SHARE_BYTES = 8_000_000
#: Bytes of one flat numpy pass, and string starts of one piece of a longer text; places must fit in the 28 low bits of a search key.
PASS_BYTES = 1_500_000

_rng = np.random.default_rng(7)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = {k: np.uint64(int(x) | 1) for k, x in zip((1, 2, 4, 8, 16), _rng.integers(1, 2**63, 5, dtype=np.uint64), strict=True)}
_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
COPY, GRAMS, MASKS = 0, 1, 2
RIGHT_SCHEMA = "share long, kind int, payload binary"


def _gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on; shorter at the end than ``raw`` by GRAM - 1."""
    h = {1: _TABLE[raw]}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * _STEP[k] + h[k][k:]
    n = len(raw) - GRAM + 1
    x = h[16][:n] * _STEP[16] + h[4][16 : 16 + n]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys, by doubling."""
    n, k, out = len(key) - width + 1, 1, key
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[:n], out[width - k : width - k + n])


class Triggers:
    """Triggers of some texts that lie end to end in ``raw``."""

    def __init__(self, texts: list[bytes], length: int):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.begin = self.end - size
        if len(self.raw) < length:
            self.place = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.gram = np.empty(0, np.uint64)
            return
        h = _gram_hash(self.raw)
        key = (h & ~np.uint64(0xFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        least = (_least(key, length - GRAM + 1) & np.uint64(0xFFFFFFF)).astype(np.int64)
        whole = np.ones(len(least), bool)  # string starts whose string ends within their text
        for b, e in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            whole[max(b, e - length + 1) : e] = False
        start = np.flatnonzero(whole)
        least = least[start]
        if not len(start):
            self.place = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.gram = np.empty(0, np.uint64)
            return
        lead = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        self.place = least[lead]
        self.high = self.place - start[lead]  # farthest string start before the trigger
        self.low = self.place - start[np.append(lead[1:], len(start)) - 1]
        self.gram = h[self.place] & ~np.uint64(1)
        self.doc = np.searchsorted(self.end, self.place, "right")


def _passes(texts: list[bytes], length: int):
    """(texts' places, pieces' first bytes, pieces) of about ``PASS_BYTES`` at a time.

    A longer text comes in pieces that share ``length`` - 1 bytes, so that each of its strings starts and ends in one.
    """
    of, first, pieces, size = [], [], [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(len(t) - length + 1, 1), PASS_BYTES):
            piece = t[begin : begin + PASS_BYTES + length - 1]
            if size and size + len(piece) > PASS_BYTES:
                yield of, first, pieces
                of, first, pieces, size = [], [], [], 0
            of.append(i)
            first.append(begin)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield of, first, pieces


def _parse(left: pa.Table, right: pa.Table):
    """Rows of a share that are not copies, in a fixed order: ids, texts, places in ``left``; the copies; payloads by kind."""
    payload: dict[int, list[bytes]] = {COPY: [], GRAMS: [], MASKS: []}
    for kind, x in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True):
        payload[kind].append(x)
    copies = set(map(tuple, np.frombuffer(b"".join(payload[COPY]), "<i8").reshape(-1, 2).tolist()))
    rows = sorted(zip(left.column("doc_id").to_pylist(), left.column("digest").to_pylist(), left.column("raw").to_pylist(), range(len(left)), strict=True))
    own = [(d, r, k) for d, h, r, k in rows if (d, h) not in copies]
    ids, texts, places = (list(x) for x in zip(*own, strict=True)) if own else ([], [], [])
    return ids, texts, places, [(d, r, k) for d, h, r, k in rows if (d, h) in copies], payload


def _packed(keys: np.ndarray, *columns: np.ndarray) -> dict[int, list[bytes]]:
    """Bytes of the columns, by key."""
    if not len(keys):
        return {}
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    stop = np.append(cut[1:], len(k))
    cols = [c[order] for c in columns]
    return {int(k[b]): [c[b:e].tobytes() for c in cols] for b, e in zip(cut.tolist(), stop.tolist(), strict=True)}


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _contexts(t: Triggers, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What follows each trigger (length bytes) and what precedes it backwards, zero beyond what its strings reach."""
    reach = length - GRAM
    after_place = t.place[at, None] + np.arange(length)
    after = np.where(np.arange(length) < (length - t.low[at])[:, None], t.raw[np.minimum(after_place, len(t.raw) - 1)], 0).astype(np.uint8)
    before_place = t.place[at, None] - 1 - np.arange(reach)
    before = np.where(np.arange(reach) < t.high[at][:, None], t.raw[np.maximum(before_place, 0)], 0).astype(np.uint8)
    return after, before


def _suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows and the common prefix of each with its predecessor."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate(([0], common))


def owned_elsewhere(after: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Bit a of each row: its string that begins a bytes before the trigger also starts in a smaller document."""
    n = len(doc)
    mask = np.zeros(n, np.uint32)
    if n < 2:
        return mask
    parse, parse_lcp = _suffix_order(after)
    dictionary, dictionary_lcp = _suffix_order(before)
    by_doc = np.argsort(doc, kind="stable")
    doc_rank = np.empty(n, np.int64)
    sorted_doc = doc[by_doc]
    doc_rank[by_doc] = np.cumsum(np.concatenate(([0], sorted_doc[1:] != sorted_doc[:-1])))
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(length - GRAM + 1):
        rows = np.flatnonzero((low <= a) & (a <= high))
        if len(rows) < 2:
            continue
        right[parse] = np.cumsum(parse_lcp < length - a)
        left[dictionary] = np.cumsum(dictionary_lcp < a) if a else 0
        place = left[rows] * np.int64(n + 1) + right[rows]
        order = np.lexsort((doc_rank[rows], place))
        p, d = place[order], doc_rank[rows][order]
        lead = np.concatenate(([True], p[1:] != p[:-1]))
        owner = d[lead][np.cumsum(lead) - 1]
        mask[rows[order[d > owner]]] |= np.uint32(1 << a)
    return mask


def _table(share: list[int], kind: list[int], payload: list[bytes], key: str = "share") -> pa.Table:
    return pa.table({key: pa.array(share, pa.int64()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept_text``: the remaining bytes as text.

    A cut may leave part of a character; such bytes are no text and are missing from ``kept_text`` only. The columns
    named in ``carry`` go along with their row, as the struct ``row``, which spares a join by id afterwards.
    """
    if not 32 <= length <= GRAM + 31:
        raise ValueError(f"length must lie between 32 and {GRAM + 31}")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []))
    rows = rows.withColumn("digest", F.xxhash64("raw"))
    # copies: texts by digest of all their bytes; a row whose text also occurs under a smaller id is settled
    keyed = rows.select("doc_id", "digest", F.unhex(F.sha2("raw", 256)).alias("full"), F.octet_length("raw").alias("n"))
    keyed = materialize(keyed, "digests")
    count, total = (x or 0 for x in keyed.agg(F.count("*"), F.sum("n")).first())
    shares = max(8, math.ceil(total / SHARE_BYTES))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares))
    first = keyed.groupBy("full").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    copies = joined_with_hot_keys(keyed, first, "full", "times", count).where("doc_id > first").select(share.alias("share"), "doc_id", "digest").distinct()
    copies = copies.mapInArrow(_pack_copies, RIGHT_SCHEMA)
    held = rows.select(share.alias("share"), "doc_id", "digest", "raw", *(["row"] if carry else []))

    def grams(left: pa.Table, right: pa.Table) -> pa.Table:
        _, texts, *_ = _parse(left, right)
        found, owner = [], []
        for of, _, part in _passes(texts, length):
            t = Triggers(part, length)
            found.append(t.gram)
            owner.append(np.array(of, np.int64)[t.doc])
        if not found:
            return _table([], [], [], "bucket")
        gram, doc = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        lead = np.concatenate(([True], gram[1:] != gram[:-1]))[: len(gram)]
        several = np.zeros(len(gram), bool)
        several[1:] = (gram[1:] == gram[:-1]) & (doc[1:] != doc[:-1])
        flag = np.logical_or.reduceat(several, np.flatnonzero(lead)) if len(gram) else several
        gram = gram[lead] | flag.astype(np.uint64)
        me = left.column("share")[0].as_py()
        packs = _packed(_bucket(gram, shares), gram)
        return _table(list(packs), [0] * len(packs), [np.int64(me).tobytes() + p[0] for p in packs.values()], "bucket")

    def sift(t: pa.Table) -> pa.Table:
        gram, owner = [], []
        for p in t.column("payload").to_pylist():
            g = np.frombuffer(p, "<u8", offset=8)
            gram.append(g)
            owner.append(np.full(len(g), np.frombuffer(p, "<i8", 1)[0]))
        g, s = np.concatenate(gram), np.concatenate(owner)
        bare = g & ~np.uint64(1)
        order = np.argsort(bare, kind="stable")
        b, lead = bare[order], None
        lead = np.concatenate(([True], b[1:] != b[:-1]))
        many = np.diff(np.append(np.flatnonzero(lead), len(b))) > 1
        many |= np.bitwise_or.reduceat(g[order] & np.uint64(1), np.flatnonzero(lead)).astype(bool)
        keep = order[many[np.cumsum(lead) - 1]]
        packs = _packed(s[keep], bare[keep])
        return _table(list(packs), [GRAMS] * len(packs), [p[0] for p in packs.values()])

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, _, _, payload = _parse(left, right)
        wanted = np.unique(np.frombuffer(b"".join(payload[GRAMS]), "<u8"))
        out: dict[int, list[bytes]] = {}
        me, base = np.int64(left.column("share")[0].as_py()).tobytes() if len(left) else b"", 0
        parts = []
        for of, _, part in _passes(texts, length):
            t = Triggers(part, length)
            at = np.searchsorted(wanted, t.gram)
            at = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == t.gram) if len(wanted) else np.empty(0, np.int64)
            after, before = _contexts(t, at, length)
            head = np.stack((t.low[at], t.high[at]), axis=1).astype(np.uint8)
            body = np.concatenate((head, after, before), axis=1)
            parts.append((t.gram[at], np.array(ids, np.int64)[np.array(of, np.int64)[t.doc[at]]], at + base, body))
            base += len(t.place)
        if not parts:
            return _table([], [], [], "bucket")
        gram, doc, name, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        # each distinct context once, under its least document; the others follow it
        padded = np.zeros((len(body), -(-body.shape[1] // 8) * 8), np.uint8)
        padded[:, : body.shape[1]] = body
        digest = (padded.view("<u8") * _MIX[: padded.shape[1] // 8]).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((doc, digest))
        d = digest[order]
        lead = np.concatenate(([True], d[1:] != d[:-1]))[: len(d)]
        # a digest shared by two contexts would be seen here; each row then stands alone
        same = np.concatenate(([True], (body[order][1:] == body[order][:-1]).all(axis=1)))[: len(d)]
        lead |= ~same
        chief = order[lead][np.cumsum(lead) - 1]
        rank = np.empty(len(order), np.int64)
        rank[order] = chief
        heads = order[lead]
        bucket = _bucket(gram, shares)
        follow = np.setdiff1d(np.arange(len(order)), heads, assume_unique=True)
        a = _packed(bucket[heads], doc[heads], name[heads].astype(np.uint32), body[heads])
        b = _packed(bucket[follow], name[follow].astype(np.uint32), name[rank[follow]].astype(np.uint32), (doc[follow] > doc[rank[follow]]).astype(np.uint8))
        for key, (dd, nn, bb) in a.items():
            f = b.get(key, [b"", b"", b""])
            out[key] = me + np.array([len(nn) // 4, len(f[0]) // 4], "<u4").tobytes() + dd + nn + bb + f[0] + f[1] + f[2]
        return _table(list(out), [0] * len(out), list(out.values()), "bucket")

    def own(t: pa.Table) -> pa.Table:
        width, reach = length, length - GRAM
        share_of, doc, name, body, followers = [], [], [], [], []
        base = 0
        for p in t.column("payload").to_pylist():
            s = np.frombuffer(p, "<i8", 1)[0]
            n, k = np.frombuffer(p, "<u4", 2, 8).tolist()
            at = 16
            doc.append(np.frombuffer(p, "<i8", n, at))
            name.append(np.frombuffer(p, "<u4", n, at := at + 8 * n))
            body.append(np.frombuffer(p, np.uint8, n * (2 + width + reach), at := at + 4 * n).reshape(n, -1))
            f, c = np.frombuffer(p, "<u4", k, at := at + n * (2 + width + reach)), np.frombuffer(p, "<u4", k, at := at + 4 * k)
            larger = np.frombuffer(p, np.uint8, k, at + 4 * k).astype(bool)
            order = np.argsort(name[-1], kind="stable")
            followers.append((s, f, base + order[np.searchsorted(name[-1][order], c)], larger))
            share_of.append(np.full(n, s))
            base += n
        share_of, doc, name, body = (np.concatenate(x) for x in (share_of, doc, name, body))
        low, high = body[:, 0].astype(np.int64), body[:, 1].astype(np.int64)
        mask = owned_elsewhere(body[:, 2 : 2 + width], body[:, 2 + width :], low, high, doc, width)
        full = (((np.uint64(2) << high.astype(np.uint64)) - np.uint64(1)) & ~((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1))).astype(np.uint32)
        s_all, n_all, m_all = [share_of], [name], [mask]
        for s, f, c, larger in followers:
            s_all.append(np.full(len(f), s))
            n_all.append(f)
            m_all.append(np.where(larger, full[c], mask[c]))
        s, n, m = np.concatenate(s_all), np.concatenate(n_all), np.concatenate(m_all)
        hit = m > 0
        packs = _packed(s[hit], np.stack((n[hit], m[hit]), axis=1).astype("<u4"))
        return _table(list(packs), [MASKS] * len(packs), [p[0] for p in packs.values()])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, places, copied, payload = _parse(left, right)
        marks = np.frombuffer(b"".join(payload[MASKS]), "<u4").reshape(-1, 2)
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        out: list[tuple] = []
        for d, r, _ in copied:
            gone = len(r) if len(r) >= length else 0
            kept = b"" if gone else r
            out.append((d, len(r), gone, int(gone > 0), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
        base, covered = 0, np.empty(0, bool)
        for of, first, part in _passes(texts, length):
            t = Triggers(part, length)
            lo, hi = np.searchsorted(marks[:, 0], [base, base + len(t.place)])
            mine = marks[lo:hi]
            place = t.place[mine[:, 0].astype(np.int64) - base]
            edge = np.zeros(len(t.raw) + length + 1, np.int32)
            for a in range(length - GRAM + 1):
                start = place[(mine[:, 1] >> np.uint32(a)) & np.uint32(1) > 0] - a
                edge[start] += 1
                edge[start + length] -= 1
            gone = np.cumsum(edge[: len(t.raw)]) > 0
            base += len(t.place)
            for i, f, b, e in zip(of, first, t.begin.tolist(), t.end.tolist(), strict=True):
                r = texts[i]
                if e - b == len(r):
                    g = gone[b:e]
                else:  # a piece: what it covers may reach into the next one
                    covered = covered if f else np.zeros(len(r), bool)
                    covered[f : f + e - b] |= gone[b:e]
                    if f + e - b < len(r):
                        continue
                    g = covered
                n = int(g.sum())
                kept = np.frombuffer(r, np.uint8)[~g].tobytes() if n else r
                spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0
                out.append((ids[i], len(r), n, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
        made = pa.table([pa.array(c, k) for c, k in zip(cols, types, strict=True)][: len(names)], names=names)
        return made.append_column("row", left.column("row").take(pa.array([k for *_, k in copied] + places, pa.int64()))) if carry else made

    sent = "bucket long, kind int, payload binary"
    repeated = _cogrouped(held, copies, grams, sent).groupBy("bucket").applyInArrow(sift, RIGHT_SCHEMA)
    masks = _cogrouped(held, copies.unionByName(repeated), contexts, sent).groupBy("bucket").applyInArrow(own, RIGHT_SCHEMA)
    result = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    if carry:
        result = result.add("row", held.schema["row"].dataType)
    return _cogrouped(held, copies.unionByName(masks), cut, result)


def _pack_copies(batches):
    for b in batches:
        pairs = np.stack([b.column("doc_id").to_numpy(), b.column("digest").to_numpy()], axis=1).astype("<i8")
        packs = _packed(b.column("share").to_numpy(), pairs)
        yield pa.RecordBatch.from_arrays([pa.array(list(packs), pa.int64()), pa.array([COPY] * len(packs), pa.int32()), pa.array([p[0] for p in packs.values()], pa.binary())], names=["share", "kind", "payload"])


def _cogrouped(left: DataFrame, right: DataFrame, f, schema: str | T.StructType) -> DataFrame:
    return left.groupBy("share").cogroup(right.groupBy("share")).applyInArrow(f, schema)
