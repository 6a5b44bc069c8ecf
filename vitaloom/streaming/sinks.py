"""Streaming sinks: server-sent frames, appended turns, and files that are processed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(payload: Column) -> Column:
    """One server-sent frame of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


LAST_FRAME = "data: [DONE]\n\n"


def turns(stream: DataFrame, sources: str = "sources") -> DataFrame:
    """Turns of a conversation as they are stored: an empty list of sources is none."""
    return stream.withColumn(sources, F.when(F.size(sources) > 0, F.col(sources)))


def appended(stream: DataFrame, path: str, checkpoint: str, query_name: str | None = None):
    """Append a stream to a table folder, each batch once: the folder is named by the batch, so a repeated batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.queryName(query_name) if query_name else w).start()


def arriving_files(spark: SparkSession, path: str, process: Callable[[DataFrame, int], None], checkpoint: str):
    """The ingestion queue: files of a folder, each processed once; the checkpoint makes it survive a restart."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
