"""Token ids of a word-level BPE tokenizer file, with plain words merged in vectorised rounds.

White space never reaches a token, so words between blanks are tokenised alone. Words of plain letters, with a
full stop or comma behind at most, take the numpy merge rounds; any other word goes through the ``tokenizers``
library itself. Both ways give the library's ids.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from vitaloom.llm.merges import MergeTable, merge_words
from vitaloom.llm.units import UnitEncoder

_BLANK, _LETTER, _STOP, _OTHER = range(4)


def _byte_chars() -> list[str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class WordIds(UnitEncoder):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.table = MergeTable(pairs)
        latin = [c for c in map(chr, range(256)) if c.isalpha() and c not in "ªº" and c != "µ"]
        self.kind = np.full(0x110000, _OTHER, np.uint8)
        self.kind[list(map(ord, latin))] = _LETTER
        self.kind[[ord(" "), ord("\n")]] = _BLANK
        self.kind[[ord("."), ord(",")]] = _STOP
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[list(map(ord, latin))] = [ord(c.lower()) for c in latin]

    def cut(self, code, head):
        kind = self.kind[code]
        blank = kind == _BLANK
        before = np.concatenate(([True], blank[:-1])) | head
        begin = before & ~blank
        begins = np.flatnonzero(begin)
        if not len(begins):
            return code, begins, blank
        # a stop counts as plain at the end of a word that began before it; anything else makes the word odd
        ends_word = np.concatenate((blank[1:] | head[1:], [True]))
        bad = (kind == _OTHER) | ((kind == _STOP) & (~ends_word | begin))
        odd = np.logical_or.reduceat(bad, begins)
        of = np.cumsum(begin) - 1
        alone = (kind == _STOP) & ~odd[np.maximum(of, 0)]
        plain_letter = (kind == _LETTER) & ~odd[np.maximum(of, 0)]
        code = np.where(plain_letter, self.lower[np.minimum(code, 255)], code)
        return code, np.flatnonzero(begin | alone), blank

    def encode_units(self, code, lengths):
        begins = np.cumsum(lengths) - lengths
        kind = self.kind[code]
        plain = (np.maximum.reduceat(kind, begins) < _OTHER) & ((np.maximum.reduceat(kind, begins) == _LETTER) | (lengths == 1))
        own = np.repeat(plain, lengths)
        size = lengths + np.add.reduceat((code > 127).astype(np.int64), begins)
        raw = np.frombuffer(code[own].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(size[plain]) - 1
        symbols[ends] = self.last[raw[ends]]
        flat, sizes = merge_words(symbols, size[plain], self.table)
        if plain.all():
            return flat, sizes
        odd = np.flatnonzero(~plain)
        words = [code[b : b + n].tobytes().decode("utf-32-le", "surrogatepass") for b, n in zip(begins[odd].tolist(), lengths[odd].tolist(), strict=True)]
        found = [np.array(e.ids, np.int64) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.zeros(len(lengths), np.int64)
        counts[plain], counts[odd] = sizes, list(map(len, found))
        out, mask = np.empty(counts.sum(), np.int64), np.repeat(plain, counts)
        out[mask] = flat
        out[~mask] = np.concatenate(found)
        return out, counts

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens, unsigned 32 bit."""
        flat, counts = self.encode(texts)
        return np.split(flat.astype("<u4"), np.cumsum(counts)[:-1]) if texts else []


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
