"""Files of owners under one root, read and written by Spark's Python data source API.

Paths are ``owner/name``, both cleaned of what a file system or an object key could misread. A path that is absolute or has an empty or ``..`` part is refused
before anything is touched. Reading deals owners to tasks, and each task lists and reads its owners' files; the option ``owner`` narrows that to one folder.
Writing puts each file under a temporary name first, so that a reader never sees half of one, and a task that runs twice leaves the same files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, owner string, name string, length long, content binary"
#: Owners of one task, and bytes of one batch of files.
OWNERS_A_TASK, BATCH_BYTES = 50, 16 << 20
SEGMENT_CHARS = 200


def safe_segment(c: Column) -> Column:
    """Owner or file name as a part of a path; null where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_"), r"^\.+", "_")
    return F.nullif(F.left(plain, F.lit(SEGMENT_CHARS)), F.lit(""))


def store_path(owner: Column, name: Column) -> Column:
    """Where a file is kept; null where owner or name leave nothing."""
    return F.concat(safe_segment(owner), F.lit("/"), safe_segment(name))


def is_safe(path: Column) -> Column:
    """False for null, empty and absolute paths, and for those with an empty or ``..`` part."""
    return F.coalesce((path != "") & ~F.exists(F.split(path, r"[/\\]"), lambda p: (p == "") | (p == "..")), F.lit(False))


def _checked(path: str) -> str:
    if not path or any(p in ("", "..") for p in re.split(r"[/\\]", path)):
        raise ValueError(f"Invalid storage path: {path!r}")
    return path


def _root(uri: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path.rstrip("/")


def _children(system: pafs.FileSystem, folder: str, kind: pafs.FileType) -> list[pafs.FileInfo]:
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == kind and not f.base_name.startswith(".")), key=lambda f: f.base_name)


@dataclass
class Owners(InputPartition):
    names: list[str]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.owner = options["path"], options.get("owner")

    def partitions(self) -> list[InputPartition]:
        if self.owner is not None:
            return [Owners([_checked(self.owner)])]
        system, root = _root(self.uri)
        names = [f.base_name for f in _children(system, root, pafs.FileType.Directory)]
        return [Owners(names[k : k + OWNERS_A_TASK]) for k in range(0, len(names), OWNERS_A_TASK)] or [Owners([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = _root(self.uri)
        rows, size = [], 0
        for owner in partition.names:
            for f in _children(system, f"{root}/{owner}", pafs.FileType.File):
                with system.open_input_stream(f.path) as stream:
                    content = stream.read()
                rows.append((f"{owner}/{f.base_name}", owner, f.base_name, len(content), content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "owner", "name", "length", "content"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class StoreWriter(DataSourceWriter):
    """Rows of (path, content); others of the same path are overwritten."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _root(self.uri)
        files, temp = 0, None
        try:
            for row in iterator:
                target = f"{root}/{_checked(row.path)}"
                folder, name = target.rsplit("/", 1)
                system.create_dir(folder, recursive=True)
                temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(temp) as out:
                    out.write(bytes(row.content or b""))
                system.move(temp, target)
                temp, files = None, files + 1
        except BaseException:
            if temp is not None and system.get_file_info(temp).type == pafs.FileType.File:
                system.delete_file(temp)
            raise
        return Written(files)


class FileStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "owner_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StoreWriter(self.options)


def files(spark: SparkSession, root: str, owner: str | None = None) -> DataFrame:
    """path, owner, name, length, content of all files, or of one owner's."""
    spark.dataSource.register(FileStore)
    reader = spark.read.format(FileStore.name()).option("path", root)
    return (reader.option("owner", owner) if owner is not None else reader).load()


def saved(df: DataFrame, root: str, owner: str = "owner", name: str = "name", content: str = "content") -> DataFrame:
    """Store the files of ``df``; returns it with the ``path`` that each has. A row whose owner or name leaves nothing stops the job."""
    path = store_path(F.col(owner), F.col(name))
    kept = df.withColumn("path", F.when(is_safe(path), path).otherwise(F.raise_error(F.lit("Invalid storage path segment"))))
    df.sparkSession.dataSource.register(FileStore)
    kept.select("path", F.col(content).alias("content")).write.format(FileStore.name()).option("path", root).mode("append").save()
    return kept


def deleted(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """path, gone: what lay there is removed; nothing at a path, or one that is refused, is no error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _root(root)
        for b in batches:
            gone = []
            for p in b["path"]:
                try:
                    system.delete_file(f"{top}/{_checked(p)}")
                    gone.append(True)
                except (ValueError, OSError):
                    gone.append(False)
            yield b.assign(gone=gone)

    return paths.select(F.col(path).alias("path")).mapInPandas(run, "path string, gone boolean")


def saved_with(df: DataFrame, root: str, record: Callable[[DataFrame], None], **columns: str) -> DataFrame:
    """Store files, then have ``record`` note them; if that fails, the files go again, so that none lies there without a record."""
    kept = saved(df, root, **columns)
    try:
        record(kept)
    except BaseException:
        deleted(kept.select("path"), root).write.format("noop").mode("overwrite").save()
        raise
    return kept


def deleted_owners(owners: DataFrame, root: str, owner: str = "owner") -> DataFrame:
    """owner, gone: everything stored for an owner is removed, whatever it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _root(root)
        for b in batches:
            gone = []
            for o in b["owner"]:
                folder = f"{top}/{_checked(o)}" if isinstance(o, str) and o else None
                there = folder is not None and system.get_file_info(folder).type == pafs.FileType.Directory
                if there:
                    system.delete_dir(folder)
                gone.append(there)
            yield b.assign(gone=gone)

    return owners.select(safe_segment(F.col(owner)).alias("owner")).distinct().mapInPandas(run, "owner string, gone boolean")
