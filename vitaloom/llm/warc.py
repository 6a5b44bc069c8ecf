"""Deterministic sharded WARC archives, written and read back by Spark tasks.

Records are dealt to ranges of page ids (shards) of about equal bytes, whose borders follow from exact running sums over the
sorted ids, whatever gaps these have. A shard is sorted and is one task's stream: every record is its own gzip member, files roll by
compressed size, headers and digests are made anew. A file is written under a temporary name and, when complete, renamed to
one that holds the start of its digest; a manifest with name, size, digest and record count of each file comes last, as a new version
beside the old one. Readers follow the greatest version of the manifest, so half-written files of a lost executor are never read, a
repeated task renames an identical file over the first one, and an archive that is written anew stays readable as it was until then.

Equal payloads of ``min_revisit_bytes`` or more are stored once, with the largest page id; the others are revisit
records that keep the HTTP header (with the full length) and the payload digest.

Defined results: a null payload counts as empty, a null url is written as an empty one, rows without a page id are left
out, rows that repeat page id and payload are each a record of the same type, extra columns are ignored, an empty table
gives an archive without files.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import _forget, fresh_path, materialize

SHARD_BYTES = 16_000_000
FILE_BYTES = 8_000_000
#: Shards of one archive at most; beyond it they grow. Bounds what the driver gets: one id a shard.
SHARDS = 20_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard long, seq long, file string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has everything but the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-1:-1] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(map(chr, range(33, 127)))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one shard, one after the other, each under a temporary name until it is complete."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.root = _filesystem(folder)
        self.limit, self.shard, self.out, self.done = file_bytes, None, None, []

    def put(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        member = _member(data)
        if self.out is not None and self.n_bytes + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.temp = f"{self.root}/.part-{self.shard:06d}-{self.seq:05d}.{uuid.uuid4().hex}.tmp"
            self.out, self.n, self.n_bytes, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.n += 1
        self.n_bytes += len(member)
        self.sha.update(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:06d}-{self.seq:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
        self.fs.move(self.temp, f"{self.root}/{name}")
        self.done.append((self.shard, self.seq, name, self.n, self.n_bytes, self.sha.hexdigest()))
        self.seq, self.out = self.seq + 1, None

    def abandon(self) -> None:
        """After an error: the open file goes, finished ones stay without effect until the manifest names them."""
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.temp)


def shard_starts(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First page id of each shard, for rows of page_id and bytes: rows go to a shard by the bytes of all rows up to theirs."""
    spark = sizes.sparkSession
    ranged = materialize(sizes.repartitionByRange("page_id").withColumn("range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(ranged.groupBy("range").agg(F.sum("bytes").alias("bytes")).collect()):  # a row a shuffle partition
        before.append((r["range"], total))
        total += r["bytes"]
    if not before:
        return []
    size = max(shard_bytes, math.ceil(total / SHARDS))
    running = F.sum("bytes").over(Window.partitionBy("range").orderBy("page_id"))  # rows of one id count together
    placed = ranged.withColumn("upto", running).join(F.broadcast(spark.createDataFrame(before, "range int, before long")), "range")
    shard = F.floor((F.col("before") + F.col("upto") - 1) / size)
    return sorted(r["start"] for r in placed.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("start")).collect())


def shard_of(starts: list[int]) -> Column:
    """Number of the shard that holds ``page_id``: search in the starts in two steps, so that few are compared."""
    step = max(1, math.isqrt(len(starts)))
    groups = [starts[k : k + step] for k in range(0, len(starts), step)]
    below = lambda array: f"size(filter({array}, x -> x <= page_id))"
    first = f"greatest(1, {below(f"from_json('{[g[0] for g in groups]}', 'array<bigint>')")})"
    return F.expr(f"transform(array({first}), g -> (g - 1) * {step} + greatest(1, {below(f"element_at(from_json('{groups}', 'array<array<bigint>>'), g)")}) - 1)[0]")


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = materialize(rows.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("n")), "payloads")
    shared = keyed.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = keyed.join(shared, "digest").where("page_id < refers_to").select("page_id", F.col("digest").alias("of"), "refers_to").distinct()
    starts = shard_starts(keyed.select("page_id", (F.col("n") + 500).alias("bytes")), shard_bytes)
    shard_expr = shard_of(starts) if starts else F.lit(0)
    # a revisit's mark travels to its page's shard and is sorted before the page, so payloads are dealt out once
    shard_col = lambda df: df.withColumn("shard", shard_expr)
    marks = shard_col(revisits).select("shard", "page_id", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("url"), F.col("of").alias("payload"), "refers_to")
    pages_ = shard_col(rows).select("shard", "page_id", F.lit(1).alias("turn"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    streams = marks.unionByName(pages_).repartition(max(1, len(starts)), "shard").sortWithinPartitions("shard", "page_id", "turn", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, file_bytes)
        try:
            page, marked = None, {}
            for b in batches:
                for s, p, turn, u, x, r in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "turn", "url", "payload", "refers_to")), strict=True):
                    if p != page:
                        page, marked = p, {}
                    if turn == 0:
                        marked[x] = r
                    else:
                        roller.put(s, record(p, u, x, marked.get(hashlib.sha256(x).digest()) if marked else None))
            roller.close()
        except BaseException:
            roller.abandon()
            raise
        cols = list(zip(*roller.done, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "seq", "file", "n_records", "n_bytes", "sha256"])

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(conf)
    fs.mkdirs(hadoop(f"{folder}/_manifest"))
    temp = f"{folder}/_manifest/.{uuid.uuid4().hex}.tmp"
    streams.mapInArrow(run, MANIFEST).write.parquet(temp)
    old = _versions(spark, folder)
    if not fs.rename(hadoop(temp), hadoop(f"{folder}/_manifest/v{max(old, default=0) + 1:08d}")):
        raise OSError(f"the manifest of {folder} could not be committed")
    for v in old:
        fs.delete(hadoop(f"{folder}/_manifest/v{v:08d}"), True)
    return read_manifest(spark, folder)


def _versions(spark, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [int(n[1:]) for n in (f.getPath().getName() for f in found) if n.startswith("v")]


def read_manifest(spark, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest/v{max(_versions(spark, folder)):08d}")


def parse_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every gzip member of a stream, one member in memory at a time."""
    z, out, raw = zlib.decompressobj(31), [], b""
    while True:
        if not raw:
            raw = stream.read(chunk)
            if not raw:
                break
        out.append(z.decompress(raw))
        raw = b""
        if z.eof:
            raw = z.unused_data
            data = b"".join(out)
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def _page(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])


def read_archive(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of a committed archive; digests are checked against what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for b in batches:
            for name, sha in zip(b.column("file").to_pylist(), b.column("sha256").to_pylist(), strict=True):
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    seen = _Hashed(f)
                    for h, block in parse_records(seen):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.decode().rpartition("Content-Length: ")[2])
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                            raise ValueError(f"digests of a record in {name} do not hold")
                        rows.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, size, digest, _page(h["WARC-Refers-To"]) if kind == "revisit" else None, payload if with_payload and kind == "response" else None))
                        held += len(block)
                        if held > 4_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if seen.sha.hexdigest() != sha:
                        raise ValueError(f"{name} is not what the manifest says")
                yield _batch(rows)

    manifest = read_manifest(spark, folder).select("file", "sha256")
    files = manifest.count()  # a number of partitions, so that few rows of many bytes are not taken for little work
    return manifest.repartition(max(1, min(files, SHARDS)), "file").mapInArrow(run, RECORDS)


class _Hashed:
    def __init__(self, stream):
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to a fresh folder of the shared store and read the archive back; the folder goes when the driver exits."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write_archive(pages, folder, min_revisit_bytes)
    atexit.register(_forget, spark, folder)
    return read_archive(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
