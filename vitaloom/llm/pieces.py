"""Encoding and decoding with a byte-fallback piece vocabulary, by vectorised merge rounds.

Texts are cut between neighbouring characters that no vocabulary piece holds side by side, so no merge can cross
a cut. Each distinct unit is encoded once: all new ones lie in one flat numpy array of symbols that
:func:`vitaloom.llm.merges.merge_words` merges round by round.

Defined results: a null text counts as empty; an empty text gives no pieces, so only the begin and end ids.
Repeated rows give repeated results, extra columns are ignored, a text without blanks of any length is encoded
whole, an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitaloom.llm.common import texts_of
from vitaloom.llm.merges import MergeTable, merge_words
from vitaloom.llm.units import UnitEncoder

SPACE = "▁"
_OUTSIDE = 1 << 24


class PieceCodec(UnitEncoder):
    def __init__(self, model_path: str):
        import sentencepiece

        super().__init__()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.lib.get_piece_size()
        special = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i) for i in range(n)]
        pieces = {self.lib.id_to_piece(i): i for i in range(n) if not special[i]}
        ranks = {s: r for r, s in enumerate(sorted({self.lib.get_score(i) for i in pieces.values()}, reverse=True))}
        self.char = np.arange(0x110000, dtype=np.int32) + _OUTSIDE
        for p, i in pieces.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda s: pieces.get(s, _OUTSIDE + ord(s) if len(s) == 1 else None)
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None:
                    pairs[a, b] = (ranks[self.lib.get_score(i)], i)
        self.table = MergeTable(pairs)
        # characters of longer pieces get a small number each; near says which two stand side by side in one
        near = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        number = {c: k for k, c in enumerate(sorted({c for ab in near for c in ab}), 1)}
        self.number = np.zeros(0x110000, np.int32)
        for c, k in number.items():
            self.number[ord(c)] = k
        self.width = len(number) + 1
        self.near = np.zeros(self.width * self.width, bool)
        self.near[[number[a] * self.width + number[b] for a, b in near]] = True
        self.byte_id = np.array([self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        surface = [p.replace(SPACE, " ").encode() for p in map(self.lib.id_to_piece, range(n))]
        for b, i in enumerate(self.byte_id):
            surface[i] = bytes([b])
        for i in (self.bos, self.eos):
            surface[i] = b""
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.fromiter(map(len, surface), np.int64, n)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size

    def cut(self, code, head):
        code = np.where(code == 32, np.uint32(ord(SPACE)), code)
        num = self.number[code]
        begin = head.copy()
        begin[1:] |= ~self.near[num[:-1] * self.width + num[1:]]
        return code, np.flatnonzero(begin), None

    def encode_units(self, code, lengths):
        flat, sizes = merge_words(self.char[code].astype(np.int64), lengths, self.table)
        if not (outside := flat >= _OUTSIDE).any():
            return flat, sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        parts = [self.byte_id[list(chr(i - _OUTSIDE).encode("utf-8", "surrogatepass"))] if out else [i] for i, out in zip(flat.tolist(), outside.tolist(), strict=True)]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts).astype(np.int64), np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the begin and end ids, unsigned 32 bit."""
        flat, counts = self.encode([SPACE + t if t else "" for t in texts])
        ends = np.cumsum(counts)
        out = np.empty(len(flat) + 2 * len(texts), "<u4")
        last = ends + 2 * np.arange(1, len(texts) + 1) - 1
        first = last - counts - 1
        body = np.ones(len(out), bool)
        body[first] = body[last] = False
        out[body], out[first], out[last] = flat, self.bos, self.eos
        return np.split(out, last[:-1] + 1) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: surfaces of the pieces, without the blank that encoding puts first."""
        ids = np.asarray(ids, np.int64)
        size = self.surface_size[ids]
        ends = np.cumsum(size)
        raw = self.surface[np.repeat(self.surface_begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:  # byte pieces that make no valid text: the library's replacement rules hold
            return self.lib.decode(ids.tolist()).encode()
        return raw[1:] if raw.startswith(b" ") else raw


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode_documents(docs: DataFrame, model_path: str, with_text: bool = False) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little endian) and n_tokens of every whole text, plus the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            ids = c.encode_texts(b.column("text").to_pylist())
            cols = [b.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64())]
            if with_text:
                cols.append(pa.array([c.decode(i).decode() for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "decoded"][: len(cols)])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long" + ", decoded string" * with_text)


def roundtrip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encoding and decoding make, taken in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            ids = c.encode_texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
