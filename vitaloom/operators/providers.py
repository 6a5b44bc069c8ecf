"""Seams for external services, each with a deterministic offline default.

A provider is a function DataFrame → DataFrame or Column → Column, so a hosted one may batch calls in ``mapInPandas``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.functions import fixed

T = TypeVar("T")

EMBEDDINGS: dict[str, Callable[[Column], Column]] = {}
DIMENSIONS = 64


def embedding(name: str):
    def put(f: Callable[[Column], Column]):
        EMBEDDINGS[name] = f
        return f

    return put


@embedding("hashed")
def hashed_words(text: Column) -> Column:
    """Signed counts of hashed words, of unit length; null for a text without words. SQL functions only."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)

    def add(acc: Column, h: Column) -> Column:
        slot = F.pmod(h, F.lit(DIMENSIONS))
        sign = F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        return F.transform(acc, lambda x, i: x + F.when(i == slot, sign).otherwise(0.0))

    sums = F.aggregate(hashes, zero, add)
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(sums, lambda x: (x / norm).cast("float")))


def embedded(df: DataFrame, text_col: str, out: str = "embedding", provider: str = "hashed") -> DataFrame:
    return df.withColumn(out, EMBEDDINGS[provider](F.col(text_col)))


def refined_reading(draft: Column, refined: Column) -> Column:
    """A second reading replaces the first unless it lost more than a tenth of the text."""
    return F.when(refined.isNull() | (F.length(refined) < 0.9 * F.length(draft)), draft).otherwise(refined)


def needs_second_reading(confidence: Column, text: Column) -> Column:
    return (confidence < 80) | F.contains(F.lower(text), F.lit("[unclear"))


def slices(text: Column, size: int = 1200) -> Column:
    """Paragraphs, and pieces of ``size`` characters of those that are longer: what an entity model gets at once."""
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))))


def looked_up_once(df: DataFrame, key: str, look_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with what ``look_up`` adds to their key; it sees each distinct key once, so there is no cache to fill or to bound."""
    return df.join(look_up(df.select(key).distinct()), key, "left")


def called(df: DataFrame, width: int, call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, *order: str) -> DataFrame:
    """Rows through a Python provider, at most ``width`` calls at once; results come in the order of ``order``, whoever ends first."""
    return df.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInPandas(call, schema)


def retried(call: Callable[[], T], failure: Callable[[Exception], tuple[str, float | None]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> T:
    """``call`` with waits between attempts, as :func:`scalars.retry_wait` states them; ``failure`` tells (kind, suggested seconds)."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            kind, suggested = failure(e)
            if kind == "permanent" or attempt == attempts - 1 or (suggested or 0) > fixed.LONGEST_WAIT_SECONDS:
                raise
            wait = fixed.BACKOFF_MS[min(attempt, len(fixed.BACKOFF_MS) - 1)] if suggested is None else math.ceil(suggested * 1000) + 250
            sleep(wait / 1000)
    raise ValueError("no attempt allowed")
