"""A cache of answers as keyed state, and its batch twin.

An entry lives for a fixed time from the answer that made it, whoever asks in between; an owner holds at most ``size`` entries, of which the first made
goes when one more comes. Only first turns are answered from it and stored in it. Entries past their time go with a timer; as first made means first out, that changes no answer.
Owners are apart: an answer never crosses them (the key holds the owner), and each has its own ``size``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitaloom.functions import fixed
from vitaloom.streaming.state import micros, moments, timer_after


class Entries:
    """Live entries of one owner in the order in which they were made: key -> time of its answer."""

    def __init__(self, life: int, size: int, made: dict[str, int] | None = None):
        self.life, self.size, self.made = life, size, made or {}

    def ask(self, key: str, at: int, first_turn: bool) -> tuple[bool, int | None]:
        """(hit, time of the answer given); the answer of a later turn is made anew and not stored."""
        if not first_turn:
            return False, None
        born = self.made.get(key)
        if born is not None and at - born <= self.life:
            return True, born
        self.made.pop(key, None)
        if len(self.made) >= self.size:
            del self.made[next(iter(self.made))]
        self.made[key] = at
        return False, at


def _asked(questions: DataFrame, owner: str, at: Column, id_col: str, key: Column, first_turn: Column) -> DataFrame:
    return questions.select(owner, F.col(id_col).alias("id"), key.alias("key"), F.coalesce(first_turn, F.lit(False)).alias("first"), at.cast("timestamp").alias("at")).where(F.col(owner).isNotNull() & F.col("at").isNotNull())


def _frame(owner: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[owner, "id", "at", "hit", "answered_at"])
    return out.assign(at=moments(out["at"].tolist()), answered_at=pd.to_datetime(out["answered_at"].astype("Int64"), unit="us"))


def _schema(questions: DataFrame, owner: str, id_col: str) -> str:
    kind = lambda c: questions.schema[c].dataType.simpleString()
    return f"{owner} {kind(owner)}, id {kind(id_col)}, at timestamp, hit boolean, answered_at timestamp"


def answered(questions: DataFrame, owner: str, at: Column, id_col: str, key: Column, first_turn: Column, seconds: int = fixed.ANSWER_SECONDS, size: int = fixed.ANSWERS_HELD) -> DataFrame:
    """owner, id, at, hit, answered_at of every question (null for later turns), in one pass over each owner's questions in order of time.

    Questions flow through sorted by owner and time; of an owner only its live entries are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, whose = Entries(0, 0), None
        for b in batches:
            rows = []
            for o, i, k, first, t in zip(b[owner].tolist(), b["id"].tolist(), b["key"].tolist(), b["first"].tolist(), micros(b["at"]), strict=True):
                if whose is None or o != whose[0]:
                    held, whose = Entries(seconds * 1_000_000, size), (o,)
                rows.append((o, i, t, *held.ask(k, t, first)))
            yield _frame(owner, rows)

    rows = _asked(questions, owner, at, id_col, key, first_turn)
    return rows.repartition(owner).sortWithinPartitions(owner, "at", "id").mapInPandas(run, _schema(questions, owner, id_col))


class AnswerCache(StatefulProcessor):
    """State of an owner: a map from key to (place, time of the answer), places counting up as entries are made."""

    def __init__(self, owner: str, life: int, size: int):
        self.owner, self.life, self.size = owner, life, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "place long, born long")

    def _load(self) -> Entries:
        rows = sorted((v[0], k[0], v[1]) for k, v in self.entries.iterator())
        return Entries(self.life, self.size, {k: born for _, k, born in rows})

    def _store(self, before: dict[str, int], now: dict[str, int]) -> None:
        for k in before.keys() - now.keys():
            self.entries.removeKey((k,))
        for place, (k, born) in enumerate(now.items()):
            self.entries.updateValue((k,), (place, born))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "id"])
        held = self._load()
        before = dict(held.made)
        out = [(key[0], i, t, *held.ask(k, t, first)) for i, k, first, t in zip(new["id"].tolist(), new["key"].tolist(), new["first"].tolist(), micros(new["at"]), strict=True)]
        self._store(before, held.made)
        for t in set(held.made.values()) - set(before.values()):
            self.handle.registerTimer(timer_after(t + self.life))
        yield _frame(self.owner, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load().made
        self._store(held, {k: t for k, t in held.items() if timer_after(t + self.life) > expiredTimerInfo.getExpiryTimeInMs()})
        yield _frame(self.owner, [])

    def close(self) -> None:
        pass


def answered_stream(questions: DataFrame, owner: str, at: Column, id_col: str, key: Column, first_turn: Column, seconds: int = fixed.ANSWER_SECONDS, size: int = fixed.ANSWERS_HELD, late: str = "0 seconds") -> DataFrame:
    """Streaming twin of :func:`answered`; needs the RocksDB state store."""
    rows = _asked(questions, owner, at, id_col, key, first_turn).withWatermark("at", late)
    return rows.groupBy(owner).transformWithStateInPandas(AnswerCache(owner, seconds * 1_000_000, size), _schema(questions, owner, id_col), "append", "EventTime")
