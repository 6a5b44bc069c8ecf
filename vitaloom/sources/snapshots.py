"""Several tables that change together: one manifest a version names the files of all of them.

Rows lie in buckets by the hash of their owner, a folder a table, bucket and commit. A commit writes only the buckets that it changes, then puts the next
manifest in place by an exclusive rename: that rename is the commit. Readers take the newest manifest and see all tables as of it, never some old and some
new; what a broken commit left behind is named by no manifest. Writers begin from a version and win only if it is still the newest, or if nothing that
they changed has changed since; otherwise they get a :class:`Conflict` and start again.

The exclusive rename is Hadoop's ``FileContext.rename`` without overwriting, which HDFS does atomically; on a local disk it holds within one machine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another commit changed the same rows first."""


class Snapshots:
    """Tables under ``root`` that are keyed by the column ``owner`` and dealt to ``buckets``.

    ``before`` is called with the name of each step of a commit before it is taken: write, stage, commit.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str, buckets: int = 64, before: Callable[[str], None] = lambda step: None):
        self.spark, self.root, self.owner, self.buckets, self.before = spark, root.rstrip("/"), owner, buckets, before
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # --- manifests -------------------------------------------------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in self._fs.listStatus(folder)), default=0)

    def _load(self, version: int) -> dict:
        if not version:
            return {}
        path = self._path(self._manifest(version))
        if not self._fs.exists(path):
            raise LookupError(f"there is no version {version}")
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> bool:
        """Write a manifest aside and move it to its place; False if that version is there already."""
        staged = self._path(f"{self.root}/staged/{uuid.uuid4().hex}.json")
        self.before("stage")
        out = self._fs.create(staged, False)
        try:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            out.close()
        self.before("commit")
        jvm = self.spark.sparkContext._jvm
        target = self._path(self._manifest(version))
        self._fs.mkdirs(target.getParent())
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = rename
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(staged, target, options)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(staged, False)
            return False
        return True

    # --- reading ---------------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest by default), or some of its buckets."""
        return self._rows(self._load(self.version() if version is None else version), table, only)

    def read_all(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as of one and the same version."""
        manifest = self._load(self.version() if version is None else version)
        return {t: self._rows(manifest, t) for t in manifest}

    def _rows(self, manifest: dict, table: str, only: list[int] | None = None) -> DataFrame:
        held = manifest[table]
        paths = [f"{self.root}/{p}" for b, p in sorted(held["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(held["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    # --- writing ---------------------------------------------------------------------------------------------------

    def replace(self, rows: dict[str, DataFrame], owners: DataFrame, base: int | None = None) -> int:
        """In every table named, all rows of ``owners`` give way to the new ones, in one commit; returns its version.

        An owner without new rows in a table has none there afterwards. ``base`` is the version that the change was made from.
        """
        base = self.version() if base is None else base
        held = self._load(base)
        bucket = F.pmod(F.xxhash64(F.col(self.owner).cast("string")), F.lit(self.buckets)).cast("int")
        gone = owners.select(self.owner).distinct()
        touched = [r[0] for r in gone.select(bucket).distinct().collect()]  # at most as many as buckets
        change: dict[str, dict] = {}
        for table, new in rows.items():
            self.before("write")
            new = new.join(gone, self.owner, "left_semi").select(*new.columns)
            if table in held:
                new = self._rows(held, table, touched).join(gone, self.owner, "left_anti").unionByName(new)
            part = f"data/{table}/{uuid.uuid4().hex}"
            new.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{part}")
            there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{part}"))}
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
            change[table] = {"schema": schema, "buckets": {str(b): f"{part}/{_BUCKET}={b}" if f"{_BUCKET}={b}" in there else None for b in touched}}
        return self._commit(base, held, change)

    def _commit(self, base: int, held: dict, change: dict[str, dict]) -> int:
        while True:
            newest = self.version()
            now = self._load(newest) if newest != base else held
            was = lambda m, t, b: m.get(t, {"buckets": {}})["buckets"].get(b)
            if any(was(held, t, b) != was(now, t, b) for t, c in change.items() for b in c["buckets"]):
                raise Conflict(f"version {newest} changed what version {base} was read for")
            merged = dict(now)
            for t, c in change.items():
                buckets = now.get(t, {"buckets": {}})["buckets"] | c["buckets"]
                merged[t] = {"schema": c["schema"], "buckets": {b: p for b, p in buckets.items() if p}}
            if self._put(newest + 1, merged):
                return newest + 1

    def forget(self, keep: int = 2) -> None:
        """Remove manifests older than the newest ``keep`` and every folder that none of these names. Not while a commit is under way."""
        newest = self.version()
        kept = [self._load(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        used = {p for m in kept for t in m.values() for p in t["buckets"].values()}
        for s in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            if int(s.getPath().getName()[:12]) <= newest - keep:
                self._fs.delete(s.getPath(), False)
        for s in self._fs.globStatus(self._path(f"{self.root}/data/*/*/{_BUCKET}=*")) or []:
            name = "/".join(s.getPath().toString().rsplit("/", 4)[1:])
            if name not in used:
                self._fs.delete(s.getPath(), True)
        self._fs.delete(self._path(f"{self.root}/staged"), True)
