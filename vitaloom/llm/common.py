"""Shared folder, materialised tables and table reading for the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where a local session sets none (tests, one machine) a temporary folder is made, registered as the checkpoint
    folder and removed when the driver exits; on a cluster that would be no shared place, so it raises there.
    """
    sc = spark.sparkContext
    for found in (spark.conf.get("spark.checkpoint.dir", None), sc.getConf().get("spark.checkpoint.dir"), sc.getCheckpointDir()):
        if found:
            return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="vitaloom-")
    sc.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, True)
    return sc.getCheckpointDir() or own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vitaloom-{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with files that outlive a lost executor. The folder goes when the driver exits.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    for seen in _RECORDS:
        seen.append(out)
    return out


_RECORDS: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that are materialised inside, so that they can go once nothing reads them."""
    seen: list[DataFrame] = []
    _RECORDS.append(seen)
    try:
        yield seen
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not seen]


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df._kept_at)


@contextmanager
def records_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of ``n`` rows for jobs that run inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the session may have ended before; the folder is then the cluster's to clean
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: A key of more rows than this is hot; the hot keys sent to all tasks are this many at most.
HOT_ROWS, HOT_KEYS = 500, 100_000


def joined_with_hot_keys(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join of ``left`` (read twice, so a written table) with ``right``, which has one row a key and in ``rows`` how many of the ``total`` rows of ``left`` have it.

    Keys of more than ``HOT_ROWS`` rows, and of more than a share of the total that bounds their number by ``HOT_KEYS``, are sent to all tasks, so that their rows stay where
    they are and no key meets in one task.
    """
    hot = right.where(F.col(rows) > max(HOT_ROWS, total // HOT_KEYS))
    cold = right.where(F.col(rows) <= max(HOT_ROWS, total // HOT_KEYS))
    there = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return there.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries of an array whose running sum is made by one fold; folds of folds keep the work near linear.
FOLD = 256


def sums_before(name: str) -> Column:
    """For the array<int> in column ``name`` the sum of all entries before each one, and last the sum of all.

    A fold that appends to an array copies it at each step; so blocks of ``FOLD`` entries are folded one by one, each from
    the sum of the blocks before.
    """
    blocks = F.sequence(F.lit(0), F.floor(F.size(name) / FOLD).cast("int"))
    block = lambda b: F.slice(name, b * FOLD + 1, F.lit(FOLD))
    running = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    firsts = running(F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x)), F.lit(0))
    # a block's sums, less the one after its last entry, which is the next block's first; the last block is never full
    sums = F.zip_with(blocks, firsts, lambda b, f: F.slice(running(block(b), f), F.lit(1), F.lit(FOLD)))
    return F.flatten(F.filter(sums, lambda x: x.isNotNull()))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column, clashing names included, is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
