"""Scans: tables with projection and predicate, point look-ups, uploaded files and text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a MIME type or an extension is read as, and the largest upload.
KINDS = {
    "application/pdf": "pdf",
    "image/jpeg": "image", "image/jpg": "image", "image/png": "image", "image/webp": "image", "image/tiff": "image", "image/bmp": "image", "image/gif": "image", "image/heic": "image", "image/heif": "image",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "text", "text/csv": "text", "text/markdown": "text", "text/tab-separated-values": "text",
}
#: What is said of kinds that cannot be read.
UNSUPPORTED = {
    "application/msword": "Legacy .doc files are not supported. Please re-save the document as .docx or export it as a PDF.",
    "application/rtf": "RTF files are not supported. Please re-save the document as .docx or export it as a PDF.",
    "text/rtf": "RTF files are not supported. Please re-save the document as .docx or export it as a PDF.",
}
EXTENSIONS = {"pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image", "webp": "image", "tif": "image", "tiff": "image", "heic": "image", "docx": "docx", "txt": "text", "csv": "text", "tsv": "text", "md": "text"}
MOST_UPLOAD_BYTES = 20 * 1024 * 1024
SCANNED_BELOW = 50


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str, where: Column | None = None) -> DataFrame:
    """A table with only the columns asked for; the predicate reaches the Parquet scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, dealt evenly to all of them before costly work on each row; one of more splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def live_scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The same table as a stream of its files, a bounded number of them a micro-batch."""
    files = spark.readStream.schema(scan(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 100)
    return files.parquet(f"{sf_dir}/{name}.parque[t]").select(*columns)  # as a pattern, a file may stand where else a folder does


def look_up(df: DataFrame, id_col: str, id_: object, owner_col: str, owner: object) -> DataFrame:
    return df.where((F.col(id_col) == F.lit(id_)) & (F.col(owner_col) == F.lit(owner))).limit(1)


def kind_of_mime(mime: Column) -> Column:
    plain = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), plain)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length, content of acceptable files: known kind, neither empty nor above the limit."""
    return accepted(spark.read.format("binaryFile").load(path))


def accepted(files: DataFrame) -> DataFrame:
    """Those of (path, length, content) that may come in, with what they are read as."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension)
    return files.select("path", kind.alias("kind"), "length", "content").where(F.col("kind").isNotNull() & F.col("length").between(1, MOST_UPLOAD_BYTES))


def decoded_text(raw: Column) -> Column:
    """Text of bytes: byte-order marks first, then UTF-8 where valid. Null where neither holds (see :func:`decode_legacy`)."""
    start = F.hex(F.substring(raw, 1, 3))
    rest = lambda n: F.substring(raw, n, 1 << 30)
    return (
        F.when(start == "EFBBBF", F.try_validate_utf8(rest(4).cast("string")))
        .when(F.startswith(start, F.lit("FFFE")), F.decode(rest(3), "UTF-16LE"))
        .when(F.startswith(start, F.lit("FEFF")), F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    )


def decode_legacy(df: DataFrame, raw_col: str, out: str = "text") -> DataFrame:
    """``decoded_text`` with windows-1256 for bytes that are neither; only those rows go through Python, batch by batch."""

    @F.pandas_udf("string")
    def arabic(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: b.decode("cp1256", errors="replace") if b is not None else None)

    known = df.withColumn(out, decoded_text(F.col(raw_col)))
    return known.where(F.col(out).isNotNull()).unionByName(known.where(F.col(out).isNull()).withColumn(out, arabic(F.col(raw_col))))


def docx_text(df: DataFrame, raw_col: str, *keep: str) -> DataFrame:
    """Raw text of word-processor files, paragraph by paragraph."""

    def run(batches):
        for b in batches:
            texts = []
            for raw in b[raw_col]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    body = z.read("word/document.xml").decode()
                lines = ["".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", body, re.S)]
                texts.append(unescape("\n\n".join(lines)))
            yield pd.concat([b[list(keep)], pd.Series(texts, name="text", index=b.index)], axis=1)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep]
    return df.select(*keep, raw_col).mapInPandas(run, ", ".join([*fields, "text string"]))


#: A reader of one kind of files: (the columns kept, content) → text, is_scanned, handwritten, confidence.
Reader = Callable[[DataFrame, str], DataFrame]
READ = {"text": "string", "is_scanned": "boolean", "handwritten": "boolean", "confidence": "double", "error": "string"}


def extracted(files: DataFrame, mime_col: str, raw_col: str, *keep: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Kept columns and text, is_scanned, handwritten, confidence, error of every file, each kind by its own branch of the plan.

    Text and word-processor files are read here; ``pdf`` and ``image`` files by the reader given for them, hosted services as a rule, and without one are an
    error, as are kinds that cannot be read. An error is a row's own and stops nothing else.
    """
    readers = readers or {}
    kind = F.coalesce(kind_of_mime(F.col(mime_col)), F.lit("none"))
    slim = files.select(*keep, F.col(mime_col).alias("_mime"), F.col(raw_col).alias("_raw"), kind.alias("_kind"))
    of = lambda k: slim.where(F.col("_kind") == k)
    full = lambda df: df.select(*keep, *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in READ.items()))
    parts = [full(decode_legacy(of("text"), "_raw")), full(docx_text(of("docx").select(*keep, "_raw"), "_raw", *keep))]
    for k in ("pdf", "image"):
        if k in readers:
            parts.append(full(readers[k](of(k).select(*keep, F.col("_raw").alias("content")), "content")))
        else:
            parts.append(full(of(k).withColumn("error", F.lit(f"No reader for {k} files"))))
    plain = F.lower(F.trim(F.substring_index("_mime", ";", 1)))
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNSUPPORTED.items() for x in kv]), plain)
    parts.append(full(of("none").withColumn("error", F.coalesce(hint, F.concat(F.lit("Unsupported file type: "), F.coalesce("_mime", F.lit("")))))))
    return reduce(DataFrame.unionByName, parts)


def is_scanned(text: Column) -> Column:
    """A text layer too short to be one: the pages must be read as pictures."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < SCANNED_BELOW


def combined_pages(pages: DataFrame, id_col: str) -> DataFrame:
    """One text a document of pages (id, page, text, confidence, handwritten): marked pages in order, mean confidence of pages
    with text (rounded), handwritten if most of all pages are."""
    said = F.trim("text") != ""
    part = F.when(said, F.struct("page", F.concat(F.lit("-- page "), F.col("page").cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.lit(" --\n"), F.trim("text")).alias("t")))
    counted = pages.join(pages.groupBy(id_col).agg(F.count("*").alias("_n")), id_col)
    return counted.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"),
        F.coalesce(F.floor(F.avg(F.when(said, F.col("confidence"))) + 0.5).cast("int"), F.lit(0)).alias("confidence"),
        (F.count_if("handwritten") > F.count("*") / 2).alias("handwritten"),
    )
