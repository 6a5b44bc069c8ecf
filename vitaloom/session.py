"""A session with the settings that the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "vitaloom", master: str | None = None, **extra: str) -> SparkSession:
    """ANSI casts, UTC, adaptive execution with skew handling; anything in ``extra`` wins (underscores stand for dots)."""
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("_", "."): v for k, v in extra.items()}
    b = SparkSession.builder.appName(app).config(map=conf)
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, one machine) gets a temporary folder, which goes when the driver exits; on a cluster it would be no
    shared place, so the setting is asked for.
    """
    sc = spark.sparkContext
    for found in (spark.conf.get("spark.checkpoint.dir", None), sc.getConf().get("spark.checkpoint.dir"), sc.getCheckpointDir()):
        if found:
            return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="vitaloom-")
    sc.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, True)
    return sc.getCheckpointDir() or own


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for the tables of one job; it goes when the driver exits."""
    path = f"{shared_folder(spark)}/vitaloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended before; the folder is the cluster's to clean
        pass
