"""Token ids of many texts at once: cut into units, encode each distinct unit once, gather.

A unit is a stretch of characters whose ids do not depend on what surrounds it. Units are told apart by two
64-bit hashes and their length; those that a worker has not seen yet are encoded together (a subclass does so
with vectorised merge rounds) and kept in a bounded store. Everything a batch does is a flat numpy operation.
"""

from __future__ import annotations

import numpy as np

#: Units that a worker keeps; beyond it the store starts anew, which costs time only.
STORE_UNITS = 500_000
#: Characters of one flat pass.
PASS_CHARS = 2_500_000


class UnitEncoder:
    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self._mix = [rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
        self._powers = [self._power_table(b) for b in rng.integers(1, 2**62, 2, dtype=np.uint64)]
        self._forget()

    @staticmethod
    def _power_table(base: np.uint64, n: int = 1 << 12) -> np.ndarray:
        return np.cumprod(np.full(n, np.uint64((int(base) * 8 + 5) % 2**64), np.uint64))

    def _forget(self) -> None:
        self._hash = np.empty(0, np.uint64)
        self._check = np.empty(0, np.uint64)
        self._begin, self._size = np.empty(0, np.int64), np.empty(0, np.int64)
        self._ids = np.empty(0, np.uint32)

    # what a subclass defines
    def cut(self, code: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``code`` as it counts, begin of each unit, and a mask of characters that belong to no unit. head: mask of texts' first characters."""
        raise NotImplementedError

    def encode_units(self, code: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that lie end to end in ``code``, flat, and how many each has."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (unsigned 32 bit) and the count of each text."""
        flat, counts, part, size = [], [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > PASS_CHARS:
                f, c = self._pass(part)
                flat.append(f)
                counts.append(c)
                part, size = [], 0
        f, c = self._pass(part)
        return np.concatenate([*flat, f]), np.concatenate([*counts, c])

    def _pass(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate(([0], np.cumsum(chars)))
        head = np.zeros(len(code) + 1, bool)
        head[first] = True
        code, begins, skip = self.cut(code, head[:-1])
        if not len(begins):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        lengths = np.diff(np.append(begins, len(code)))
        if skip is not None:
            lengths -= np.add.reduceat(skip, begins, dtype=np.int64)
        place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code)))) if begins[0] == 0 else None
        if place is None:  # characters before the first unit
            whole = np.append(begins, len(code))
            place = np.concatenate((np.zeros(begins[0], np.int64), np.arange(begins[0], len(code)) - np.repeat(begins, np.diff(whole))))
        slot, low = place & 0xFFF, (code ^ (code >> np.uint32(16))) & np.uint32(0xFFFF)
        sums = []
        for mix, powers in zip(self._mix, self._powers, strict=True):
            v = mix[low] + code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            v *= powers[slot] + place.astype(np.uint64)
            if skip is not None:
                v[skip] = 0
            sums.append(np.add.reduceat(v, begins))
        h = (sums[0] ^ (sums[0] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
        unit = self._lookup(h, sums[1], code, begins, lengths)
        sizes = self._size[unit]
        ends = np.cumsum(sizes)
        flat = self._ids[np.repeat(self._begin[unit] - (ends - sizes), sizes) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))
        return flat, np.diff(upto[np.searchsorted(begins, first)])

    def _lookup(self, h: np.ndarray, check: np.ndarray, code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place of each unit in the store, after the new ones have been encoded into it."""
        while True:
            order = np.argsort(h)
            sorted_h = h[order]
            lead = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
            distinct, example = sorted_h[lead], order[lead]
            inverse = np.empty(len(h), np.int64)
            inverse[order] = np.cumsum(lead) - 1
            other = check != check[example][inverse]
            if not other.any():
                break
            h = np.where(other, h * np.uint64(0x9E3779B97F4A7C15) + check, h)  # units that share a hash with another move on
        if len(self._hash) + len(distinct) > STORE_UNITS:
            self._forget()
        at = np.searchsorted(self._hash, distinct)
        known = at < len(self._hash)
        known[known] = self._hash[at[known]] == distinct[known]
        if (self._check[at[known]] != check[example[known]]).any():
            self._forget()
            known[:] = False
        if not known.all():
            new = np.flatnonzero(~known)
            ex = example[new]
            ids, sizes = self.encode_units(code[_ranges(begins[ex], lengths[ex])], lengths[ex])
            begin = len(self._ids) + np.cumsum(sizes) - sizes
            spot = np.searchsorted(self._hash, distinct[new])
            self._hash = np.insert(self._hash, spot, distinct[new])
            self._check = np.insert(self._check, spot, check[ex])
            self._begin = np.insert(self._begin, spot, begin)
            self._size = np.insert(self._size, spot, sizes)
            self._ids = np.concatenate((self._ids, ids.astype(np.uint32)))
            at = np.searchsorted(self._hash, distinct)
        return at[inverse]


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
