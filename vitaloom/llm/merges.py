"""Vectorised byte-pair merge rounds over many words at once.

Words lie end to end in one flat array of symbols. A round finds each word's best pair (smallest rank, leftmost
among equals) with one segmented minimum, merges that pair in all words at the same time and compacts the
array. Words without a pair left retire. One merge a word and round keeps the order of a priority queue, so the
result is that of the sequential algorithm.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 62
#: Words of more symbols than this go through a priority queue, whose cost does not grow with rounds times length.
LONG = 400


class MergeTable:
    """Pairs of symbols with a rank and a product, in an open-addressed numpy hash table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        n = max(16, len(pairs))
        self.bits = int(np.ceil(np.log2(n * 4)))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.zeros(size, np.int64)
        self.product = np.zeros(size, np.int64)
        self.probes = 1
        left = np.fromiter((p[0] for p in pairs), np.int64, len(pairs))
        right = np.fromiter((p[1] for p in pairs), np.int64, len(pairs))
        keys = (left << 32) | right
        rank = np.fromiter((v[0] for v in pairs.values()), np.int64, len(pairs))
        product = np.fromiter((v[1] for v in pairs.values()), np.int64, len(pairs))
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & (size - 1)
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.rank[at[won]], self.product[at[won]] = keys[todo[won]], rank[todo[won]], product[todo[won]]
            todo = np.delete(todo, won)
            step += 1
        self.probes = step
        self.pairs = pairs

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where it is none."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        step = 1
        while len(open_) and step < self.probes:
            at = (slot[open_] + step) & (len(self.keys) - 1)
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (self.keys[at] >= 0)]
            step += 1
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word to the end: flat symbols and the words' lengths before and after.

    ``lengths`` has one entry a word, zero allowed. The order of words is kept.
    """
    n = len(lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    done: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    long_words = np.flatnonzero(lengths > LONG)
    for w in long_words:
        out = _merge_one(symbols[starts[w] : starts[w] + lengths[w]].tolist(), table.pairs)
        done.append(np.asarray(out, np.int64))
        done_word.append(np.full(len(out), w, np.int64))
    keep = lengths <= LONG
    word = np.repeat(np.arange(n), lengths)
    if len(long_words):
        mask = keep[word]
        sym, word = symbols[mask].astype(np.int64), word[mask]
    else:
        sym = symbols.astype(np.int64)
    rank = _fresh_ranks(sym, word, table)
    while len(sym):
        head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        small = np.minimum.reduceat((rank << 24) + _offsets(head, len(sym)), head)
        live = small < (_DEAD << 24)
        counts = np.diff(np.append(head, len(sym)))
        if not live.all():
            mask = np.repeat(live, counts)
            done.append(sym[~mask])
            done_word.append(word[~mask])
            sym, word, rank = sym[mask], word[mask], rank[mask]
            if not len(sym):
                break
            counts, small = counts[live], small[live]
            head = np.concatenate(([0], np.cumsum(counts)))[:-1]
        at = head + (small & 0xFFFFFF)
        sym[at] = table.product[table.find(sym[at], sym[at + 1])]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))
        sym, word, rank = sym[stay], word[stay], rank[stay]
        _rerank(sym, word, rank, moved, table)
        before = moved[(moved > 0)]
        before = before[word[before - 1] == word[before]] - 1
        _rerank(sym, word, rank, before, table)
    if not done:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    flat, owner = np.concatenate(done), np.concatenate(done_word)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=n)


def _offsets(head: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))


#: Rank of a position that starts no pair; it survives the shift by 24 bits.
_DEAD = np.int64(1) << 38


def _fresh_ranks(sym: np.ndarray, word: np.ndarray, table: MergeTable) -> np.ndarray:
    rank = np.full(len(sym), _DEAD, np.int64)
    if len(sym) > 1:
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair] = np.minimum(table.ranks(sym[pair], sym[pair + 1]), _DEAD)
    return rank


def _rerank(sym: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray, table: MergeTable) -> None:
    rank[at] = _DEAD
    at = at[at + 1 < len(sym)]
    at = at[word[at] == word[at + 1]]
    rank[at] = np.minimum(table.ranks(sym[at], sym[at + 1]), _DEAD)


def _merge_one(sym: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One very long word with a priority queue over a linked list."""
    n = len(sym)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (found := pairs.get((sym[i], sym[j]))):
            heapq.heappush(queue, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        push(i)
    while queue:
        _, i, a, b, product = heapq.heappop(queue)
        if not alive[i] or sym[i] != a or (j := nxt[i]) >= n or sym[j] != b:
            continue
        sym[i], alive[j], nxt[i] = product, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [s for s, a in zip(sym, alive, strict=True) if a]
