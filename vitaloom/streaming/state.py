"""What the stateful operators share: times as whole microseconds, and the state store that they need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(times: pd.Series) -> list[int]:
    """Microseconds since the epoch, whatever the resolution and zone."""
    plain = times.dt.tz_convert("UTC").dt.tz_localize(None) if times.dt.tz is not None else times
    return plain.astype("datetime64[us]").astype("int64").tolist()


def moments(times: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(pd.Series(times, dtype="int64"), unit="us"))


def timer_after(moment: int) -> int:
    """The timer, in milliseconds, that goes off once the watermark lies behind a moment in microseconds (timers go off at their own time)."""
    return moment // 1000 + 1


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)
