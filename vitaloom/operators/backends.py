"""Backends for entities and embeddings: what a hosted model would do, with checks on what it returns and deterministic stand-ins offline.

An entity model is a function (texts) → for each text a list of ``{"entity_group", "word", "score"}``; an embedding model is a function (texts, kind) → vectors, where
kind says whether a text is a ``query`` or a stored ``passage``. Both are registered by name and found again in the tasks, which import this module; a model of one's
own is registered in a module that the tasks can import, and named as ``module:name``.
"""

from __future__ import annotations

import hashlib
import importlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.functions import fixed
from vitaloom.operators.text import ENTITY, best_entities, found_by_rules, placed

EntityModel = Callable[[list[str]], list[list[dict]]]
EmbeddingModel = Callable[[list[str], str], list[list[float]]]

ENTITY_MODELS: dict[str, EntityModel] = {}
EMBEDDING_MODELS: dict[str, tuple[EmbeddingModel, int]] = {}

#: Texts that an embedding model gets at once.
EMBED_BATCH = 96


def entity_model(name: str) -> Callable[[EntityModel], EntityModel]:
    def put(f: EntityModel) -> EntityModel:
        ENTITY_MODELS[name] = f
        return f

    return put


def embedding_model(name: str, dimensions: int) -> Callable[[EmbeddingModel], EmbeddingModel]:
    def put(f: EmbeddingModel) -> EmbeddingModel:
        EMBEDDING_MODELS[name] = (f, dimensions)
        return f

    return put


def _named(registry: dict, name: str):
    if ":" in name:
        importlib.import_module(name.split(":")[0])
    return registry[name]


# --- entities --------------------------------------------------------------------------------------------------


@entity_model("capitals")
def capitals(texts: list[str]) -> list[list[dict]]:
    """The offline stand-in: words with a capital first take a label by their length, longer ones with more certainty."""
    labels = ("B-Disease_disorder", "I-Medication", "Lab_value", "Date")
    return [[{"entity_group": labels[len(w) % 4], "word": f" {w} ", "score": min(1.0, len(w) / 12)} for w in re.findall(r"(?<![A-Za-z])[A-Z][a-z]{3,}(?![A-Za-z])", t)] for t in texts]


def model_pieces(text: str, size: int = fixed.MODEL_CHARS) -> list[str]:
    """Paragraphs, and pieces of those that are longer than a model reads at once."""
    pieces = [p[k : k + size].strip() for p in re.split(r"\n{2,}", text) for k in range(0, len(p), size)]
    return [p for p in pieces if p]


def model_rows(found: list[list[dict]]) -> list[tuple[str, str, float, str]]:
    """What a model found as entities: labels that a record has no place for, blanks and doubtful finds are left out."""
    out = []
    for item in (e for piece in found for e in piece):
        label = re.sub(r"^[BI]-", "", item.get("entity_group") or item.get("entity") or "").lower()
        kind, word, score = fixed.MODEL_LABELS.get(label), (item.get("word") or "").strip(), float(item.get("score") or 0)
        if kind and word and score >= fixed.LEAST_MODEL_SCORE:
            out.append((word, kind, score, "model"))
    return out


def entities(docs: DataFrame, id_col: str, text_col: str, model: str | None = None) -> DataFrame:
    """id, text, type, score, source: entities by rule and, if a model is named, by it; of each (type, text) the best, rules first among equals.

    The model is a table function in a lateral join, so its rows stand beside the document that they come from. It is an advisory second reading: a text that it
    fails on has the entities of the rules alone.
    """
    trimmed = docs.withColumn("_t", F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    rules = placed(trimmed, id_col, found_by_rules(F.col("_t")))
    if model is None:
        return best_entities(rules, id_col)

    @F.udtf(returnType=f"place int, {ENTITY}", useArrow=True)
    class Model:
        def eval(self, text: str):
            try:
                found = model_rows(_named(ENTITY_MODELS, model)(model_pieces(text)))
            except Exception:  # advisory: the rules' entities stand
                found = []
            for k, e in enumerate(found):
                yield (1_000_000_000 + k, *e)

    by_model = trimmed.select(id_col, "_t").lateralJoin(Model(F.col("_t").outer())).drop("_t")
    return best_entities(rules.unionByName(by_model), id_col)


# --- embeddings ------------------------------------------------------------------------------------------------


@embedding_model("word_digests", 64)
def word_digests(texts: list[str], kind: str) -> list[list[float]]:
    """The offline default: signed counts of words by digest, of unit length, all zero for a text without words. The kind counts as a word, as asymmetric models
    put it before the text."""
    out = []
    for t in texts:
        sums = [0.0] * 64
        words = Counter(re.findall(r"[^\W_]+", t.lower()))
        for w, n in {**words, f"{kind}:": 1}.items() if words else ():
            h = hashlib.md5(w.encode()).hexdigest()
            sums[int(h[:4], 16) % 64] += n if int(h[4], 16) % 2 else -n
        norm = math.sqrt(sum(x * x for x in sums))
        out.append([x / norm for x in sums] if norm else sums)
    return out


def checked_embeddings(texts: list[str], kind: str, model: EmbeddingModel, dimensions: int, batch: int = EMBED_BATCH) -> list[list[float]]:
    """Vectors of texts, asked for in batches; another number of vectors or of components than asked for is an error, never padded or cut."""
    out: list[list[float]] = []
    for k in range(0, len(texts), batch):
        part = texts[k : k + batch]
        vectors = model(part, kind)
        if len(vectors) != len(part):
            raise ValueError(f"{len(vectors)} embeddings for {len(part)} inputs")
        for i, v in enumerate(vectors):
            if len(v) != dimensions:
                raise ValueError(f"embedding {i} has {len(v)} dimensions, expected {dimensions}")
        out += vectors
    return out


def embedded(df: DataFrame, text_col: str, kind: str, out: str = "embedding", model: str = "word_digests", batch: int = EMBED_BATCH) -> DataFrame:
    """``df`` with the embedding of a text column as ``kind`` (``query`` or ``passage``); a null text has none.

    Texts are sent in full batches whatever the size of Spark's own: what is left of one Arrow batch goes with the next.
    """
    if kind not in ("query", "passage"):
        raise ValueError(f"a text is embedded as query or as passage, not as {kind!r}")
    dimensions = _named(EMBEDDING_MODELS, model)[1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _named(EMBEDDING_MODELS, model)[0]

        def made(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
            vectors = iter(checked_embeddings([t for t in texts if t is not None], kind, ask, dimensions, batch))
            column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, out])

        held: list[pa.RecordBatch] = []
        for b in batches:
            rows = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held and len(b) else b
            full = len(rows) // batch * batch
            if full:
                yield made(rows.slice(0, full))
            held = [rows.slice(full)] if len(rows) > full else []
        for rows in held:
            yield made(rows)

    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")
