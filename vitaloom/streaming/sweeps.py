"""Work that was begun and never ended: a sweeper with a timer for each document, and its batch twin.

A document is stalled once it has been processing for longer than the limit without another update; the moment itself is not too late. The
stream tells of each such span once, as soon as the watermark or a later update of the same document has passed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitaloom.functions import fixed
from vitaloom.streaming.state import micros, moments, timer_after

_OUT = ["since", "failed_at", "note"]


class Sweeper(StatefulProcessor):
    """State of a document: since when it is being processed, nothing if it is not; one timer where the limit ends.

    Updates of one micro-batch are taken in order of time; an update older than what a document has shown before is taken as it comes.
    """

    def __init__(self, id_col: str, ties: str, minutes: int):
        self.id_col, self.ties, self.limit = id_col, ties, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "since long")

    def _timer(self, since: int) -> int:
        return timer_after(since + self.limit)

    def _clear(self) -> None:
        if self.since.exists():
            self.handle.deleteTimer(self._timer(self.since.get()[0]))
            self.since.clear()

    def _rows(self, key: tuple, spans: list[int]) -> pd.DataFrame:
        out = pd.DataFrame({self.id_col: [key[0]] * len(spans), "since": moments(spans), "failed_at": moments([s + self.limit for s in spans])})
        return out.assign(note=fixed.STALL_NOTE)[[self.id_col, *_OUT]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", self.ties])
        since = self.since.get()[0] if self.since.exists() else None
        self._clear()
        spans = []
        for at, status in zip(micros(new["at"]), new["status"].tolist(), strict=True):
            if since is not None and at > since + self.limit:
                spans.append(since)
            since = at if status == "processing" else None
        if since is not None:
            self.since.update((since,))
            self.handle.registerTimer(self._timer(since))
        yield self._rows(key, spans)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0] if self.since.exists() else None
        late = since is not None and self._timer(since) <= expiredTimerInfo.getExpiryTimeInMs()
        if late:
            self.since.clear()
        yield self._rows(key, [since] if late else [])

    def close(self) -> None:
        pass


def _work(updates: DataFrame, id_col: str, status: Column, at: Column, ties: str) -> DataFrame:
    return updates.select(id_col, ties, status.alias("status"), at.cast("timestamp").alias("at")).where(F.col(id_col).isNotNull() & F.col("at").isNotNull())


def stalls_stream(updates: DataFrame, id_col: str, status: Column, at: Column, ties: str, minutes: int = fixed.STALL_MINUTES, late: str = "0 seconds") -> DataFrame:
    """id, since, failed_at, note of every stalled span in a stream of updates; needs the RocksDB state store."""
    kind = updates.schema[id_col].dataType.simpleString()
    work = _work(updates, id_col, status, at, ties).withWatermark("at", late)
    return work.groupBy(id_col).transformWithStateInPandas(Sweeper(id_col, ties, minutes), f"{id_col} {kind}, since timestamp, failed_at timestamp, note string", "append", "EventTime")


def stalls(updates: DataFrame, id_col: str, status: Column, at: Column, ties: str, as_of: Column, minutes: int = fixed.STALL_MINUTES) -> DataFrame:
    """Batch twin: the spans that are stalled at ``as_of``."""
    following = F.lead("at").over(Window.partitionBy(id_col).orderBy("at", ties))
    limit = F.col("at") + F.expr(f"INTERVAL {minutes} MINUTES")
    work = _work(updates, id_col, status, at, ties).withColumn("until", F.coalesce(following, as_of.cast("timestamp")))
    return work.where((F.col("status") == "processing") & (F.col("until") > limit)).select(id_col, F.col("at").alias("since"), limit.alias("failed_at"), F.lit(fixed.STALL_NOTE).alias("note"))
