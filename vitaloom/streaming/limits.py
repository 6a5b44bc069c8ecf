"""Stateful operators: the fixed-window limiter that begins at the first request, and the sweeper of stalled work.

Each has a batch twin with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitaloom.functions import fixed
from vitaloom.streaming.state import micros, timer_after


def limited(events: DataFrame, keys: list[str], ts: str, ties: str, limit: int, seconds: int) -> DataFrame:
    """keys, t, id, accepted, retry_after of every event, in one pass over each key's events in time order.

    Events are sorted by key and time and flow through; of a key only the count and the end of its window are held, so a key
    with very many events costs time in one task, never memory.
    """
    rows = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(ties).alias("id"))
    window = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, reset = None, 0, 0
        for b in batches:
            accepted, waits = [], []
            for *own, t in zip(*(b[k].tolist() for k in keys), b["t"].tolist(), strict=True):
                if own != key or reset <= t:
                    key, count, reset = own, 0, t + window
                full = count >= limit
                count += not full
                accepted.append(not full)
                waits.append(max(1, -((t - reset) // 1_000_000)) if full else None)
            yield b.assign(accepted=accepted, retry_after=pd.array(waits, "Int64"))

    made = rows.withColumns({"accepted": F.lit(True), "retry_after": F.lit(None).cast("long")})
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t", "id").mapInPandas(run, made.schema)


class Limiter(StatefulProcessor):
    """State of a key: requests counted in its window and the end of the window, with a timer that ends both."""

    def __init__(self, names: list[str], ts: str, id_col: str, limit: int, window: int):
        self.names, self.ts, self.id_col, self.limit, self.window = names, ts, id_col, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "count long, reset long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values([self.ts, self.id_col])
        count, reset = self.state.get() if self.state.exists() else (0, None)
        if reset is not None:
            self.handle.deleteTimer(timer_after(reset))
        accepted, waits, times = [], [], micros(new[self.ts])
        for t in times:
            if reset is None or reset <= t:
                count, reset = 0, t + self.window
            full = count >= self.limit
            count += not full
            accepted.append(not full)
            waits.append(max(1, -((t - reset) // 1_000_000)) if full else None)
        self.state.update((count, reset))
        self.handle.registerTimer(timer_after(reset))
        own = {k: [v] * len(times) for k, v in zip(self.names, key, strict=True)}
        yield pd.DataFrame(own | {"t": times, "id": new[self.id_col].tolist(), "accepted": accepted, "retry_after": pd.array(waits, "Int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({k: [] for k in (*self.names, "t", "id", "accepted", "retry_after")})

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, keys: dict[str, str], ts: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """Streaming twin: a key's state goes once the watermark has passed the end of its window; needs the RocksDB state store."""
    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", t long, id long, accepted boolean, retry_after long"
    return events.groupBy(*keys).transformWithStateInPandas(Limiter(list(keys), ts, id_col, limit, seconds * 1_000_000), schema, "append", "EventTime")


def stalled(work: DataFrame, as_of, status: str = "status", started: str = "started_at", updated: str = "updated_at", minutes: int = fixed.STALL_MINUTES) -> DataFrame:
    """Rows that have been processing for too long; without a start the last update counts."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    return work.where((F.col(status) == "processing") & F.coalesce(F.col(started) < cutoff, F.col(updated) < cutoff))


def swept(work: DataFrame, as_of, status: str = "status", started: str = "started_at", updated: str = "updated_at", note: str = "note", minutes: int = fixed.STALL_MINUTES) -> DataFrame:
    """The table with stalled rows set to failed and a note."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    late = (F.col(status) == "processing") & F.coalesce(F.col(started) < cutoff, F.col(updated) < cutoff, F.lit(False))
    return work.withColumns({note: F.when(late, "Processing did not finish.").otherwise(F.col(note)), status: F.when(late, "failed").otherwise(F.col(status))})
