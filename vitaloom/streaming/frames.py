"""Server-sent frames as a stream sink, and frames put together again from bytes that were cut anywhere.

The sink is a Python data source: each task writes files of frames of bounded size, and the driver's commit names the files of a batch in one small file, put in place by a
rename. Readers go by these, so a batch that was aborted or written twice shows once or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from vitaloom.sources.filestore import _root

PREFIX, DONE = "data: ", "[DONE]"


#: A task begins another file of frames beyond so many bytes; readers get files in pieces of so many, as a batch has many of them.
FILE_BYTES, PIECE_BYTES = 4 << 20, 4 << 10


@dataclass
class FilesOfFrames(WriterCommitMessage):
    names: list[str]


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _root(self.uri)
        system.create_dir(f"{root}/frames", recursive=True)
        names, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"frames/{uuid.uuid4().hex}.sse")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}"), 0
                raw = row.frame.encode()
                out.write(raw)
                size += len(raw)
        finally:
            if out is not None:
                out.close()
        return FilesOfFrames(names)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, root = _root(self.uri)
        system.create_dir(f"{root}/batches", recursive=True)
        temp = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temp) as out:
            out.write(json.dumps([name for m in messages if m for name in m.names]).encode())
        system.move(temp, f"{root}/batches/{batchId:012d}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, root = _root(self.uri)
        for name in (name for m in messages if m for name in m.names):
            if system.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                system.delete_file(f"{root}/{name}")


class FrameSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse_frames"

    def schema(self) -> str:
        return "frame string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return FrameWriter(self.options)


def sent(stream: DataFrame, path: str, checkpoint: str):
    """Start writing the column ``frame`` of a stream to the sink at ``path``."""
    stream.sparkSession.dataSource.register(FrameSink)
    return stream.select("frame").writeStream.format(FrameSink.name()).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def received(spark: SparkSession, path: str) -> DataFrame:
    """name, content: the bytes of every committed file of frames."""
    named = spark.read.schema("name string").text(f"{path}/batches", wholetext=True).select(F.explode(F.from_json("name", "array<string>")).alias("name"))
    held = spark.read.format("binaryFile").load(f"{path}/frames").select(F.concat(F.lit("frames/"), F.substring_index("path", "/", -1)).alias("name"), "content")
    return held.join(named, "name", "left_semi")


def in_pieces(files: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """key, piece, content: the bytes of each file in pieces of bounded size, so that a batch of rows is bounded whatever files are."""
    n = F.ceil(F.length(content) / PIECE_BYTES).cast("int")
    numbered = files.where(F.length(content) > 0).select(key, content, F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return numbered.select(key, "piece", F.substring(content, F.col("piece") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias(content))


def reassembled(pieces: DataFrame, key: str, order: str, content: str = "content") -> DataFrame:
    """key, place, payload: the JSON payloads of each key's frames in order, from pieces of bytes cut at any place.

    Pieces flow through sorted; of a key only the unfinished line is held. A line that is no frame, or whose payload is no JSON object, is passed over; what
    follows the closing frame is not read; a last line without its end is no frame yet.
    """
    kind = pieces.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, rest, place, done = None, b"", 0, False
        for b in batches:
            out = []
            for k, raw in zip(b["key"].tolist(), b["content"].tolist(), strict=True):
                if whose is None or k != whose[0]:
                    whose, rest, place, done = (k,), b"", 0, False
                if done or raw is None:
                    continue
                *lines, rest = (rest + bytes(raw)).split(b"\n")
                for line in lines:
                    text = line.decode(errors="replace").strip()
                    if not text.startswith(PREFIX):
                        continue
                    payload = text[len(PREFIX) :]
                    if payload == DONE:
                        done, rest = True, b""
                        break
                    try:
                        sound = isinstance(json.loads(payload), dict)
                    except ValueError:
                        continue
                    if sound:
                        out.append((k, place, payload))
                        place += 1
            yield pd.DataFrame(out, columns=[key, "place", "payload"])

    rows = pieces.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(content).alias("content"))
    return rows.repartition("key").sortWithinPartitions("key", "order").mapInPandas(run, f"{key} {kind}, place long, payload string")


def answers(payloads: DataFrame, key: str) -> DataFrame:
    """key, conversation, content, sources, error: what the frames of a key say together. The first conversation and error count, the last
    sources that are a list, and all content in order."""
    v = F.try_parse_json("payload")
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    sources = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.sources", "variant")), F.lit("ARRAY")), F.to_json(F.try_variant_get(v, "$.sources", "variant")))
    said = payloads.select(key, "place", text("$.conversationId").alias("conversation"), text("$.error").alias("error"), text("$.content").alias("content"), sources.alias("sources"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    return said.groupBy(key).agg(
        first("conversation").alias("conversation"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("place", "content")))), lambda x: x["content"]), "").alias("content"),
        F.max_by("sources", F.when(F.col("sources").isNotNull(), F.col("place"))).alias("sources"),
        first("error").alias("error"),
    )
