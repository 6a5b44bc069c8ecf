"""Cleaning and packing a corpus: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each one's result to the shared
folder as Parquet and reads it back for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import packing, quality, secrets, similar, suffix
from vitaloom.llm.common import discard, materialize, recorded
from vitaloom.llm.queries import documents, prepared, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage left for its result to be read from.
_left: list[DataFrame] = []


def stage(f: Stage) -> Stage:
    """A stage's result is written before the next stage begins, so that one first removes the tables that its predecessor read from."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*(t for t in _left if t.sparkSession is spark))
        with recorded() as tables:
            out = f(spark, docs, sf_dir)
        _left[:] = tables
        return out

    return run_stage


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has it, where documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.passing(docs)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: SimHash groups of five-word shingles first, each held against Jaccard >= 0.8,
    then an exact join of what is left at the same similarity.

    It is the one with the smallest id; a row without id stays only where no row of its group has one.
    """
    prepared(spark)
    return similar.one_of_each(docs, shingle=5, similarity=80)


@stage
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document holds go; a document of which nothing is left goes.

    A cut within a character leaves no valid text, so what is left of that character goes too.
    """
    prepared(spark)
    dealt = F.col("doc_id").isNotNull() & F.col("text").isNotNull()  # no other row can lose a byte
    cut = suffix.dedup(docs.where(dealt), with_text=True, carry=tuple(c for c in docs.columns if c != "text"))
    cut = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0)).withColumnRenamed("kept_text", "text")
    left = cut.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return _sized(left.unionByName(docs.where(~dealt)))


@stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced by a mark."""
    return _sized(secrets.redact(docs, secrets.fit(spark)))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    prepared(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Merge rounds, fingerprints and forests have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir)
    before = None
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    discard(*_left)
    _left.clear()
    return docs
