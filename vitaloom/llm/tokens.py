"""Token counts of a byte-level BPE file by a heap and a linked list, without making ids.

A text is cut at the file's added tokens, each of which is one token, and the stretches between into units by the usual pattern of
byte-level vocabularies. A unit starts as its UTF-8 bytes; the adjacent pair of lowest rank (leftmost among equals) is popped from a
heap and joined in a linked list until no pair of the vocabulary is left. Its count is its bytes less the merges made. Counts of units are kept
by each worker in a bounded store.

Characters that the pattern's library and the tokenizer's class differently (newly assigned ones) are found by asking the tokenizer once for every
distinct character; a text with such a character is cut by the tokenizer itself.

Defined results: a null text counts as empty, which has no tokens; a text of any length without blanks is one unit, of cost n log n;
repeated rows give repeated results; rows without id are counted like others; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import texts_of
from vitaloom.llm.wordids import _byte_chars

# fixed values: the pre-tokenising pattern of byte-level vocabularies
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units whose count a worker keeps; beyond it the store starts anew, which costs time only.
STORE_UNITS = 500_000
_PLACE = (1 << 40) - 1


class TokenCounter(dict):
    """Counts of units (this mapping: unit -> tokens) and of whole texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec["pre_tokenizer"], spec["model"], spec["added_tokens"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not model.get("ignore_merges")
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        vocab = model["vocab"]
        self.first = [vocab[c] for c in _byte_chars()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.units = regex.compile(UNITS)
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, contents)) or r"(?!)")
        self.alike: set[str] = set(map(chr, range(128)))
        self.unlike: set[str] = set()

    def __missing__(self, unit: str) -> int:
        if len(self) >= STORE_UNITS:
            self.clear()
        self[unit] = n = self.tokens(unit.encode())
        return n

    def tokens(self, raw: bytes) -> int:
        """Initial symbols less merges of one unit."""
        n, pairs = len(raw), self.pairs
        sym = [self.first[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [p[0] << 40 | i for i in range(n - 1) if (p := pairs.get(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & _PLACE
            if sym[i] < 0 or (j := after[i]) >= n:
                continue
            pair = pairs.get(sym[i] << 32 | sym[j])
            if not pair or pair[0] != top >> 40:  # a neighbour was merged since this pair was pushed
                continue
            merges += 1
            sym[i], sym[j] = pair[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get(sym[i] << 32 | sym[k]):
                    heapq.heappush(heap, p[0] << 40 | i)
            if (h := before[i]) >= 0 and (p := pairs.get(sym[h] << 32 | sym[i])):
                heapq.heappush(heap, p[0] << 40 | h)
        return n - merges

    def _pieces(self, text: str) -> list[str]:
        for c in set(text) - self.alike - self.unlike:
            probe = f"a{c}1{c}!{c} x "
            same = [probe[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(probe)] == self.units.findall(probe)
            (self.alike if same else self.unlike).add(c)
        if self.unlike and not self.unlike.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        return self.units.findall(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text, an added token inside it being one."""
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self._pieces(p))) for p in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            text = b.column("text")
            tokens = pa.array((c.count(t.as_py()) for t in text), pa.int64())  # one text at a time is a Python string
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
