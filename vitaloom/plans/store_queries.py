"""Queries over what is stored: tables that change together, files of owners, and frames through a sink and back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from vitaloom.operators import records
from vitaloom.plans.catalogue import register
from vitaloom.session import fresh_folder
from vitaloom.sources import filestore, tables
from vitaloom.sources.snapshots import Snapshots
from vitaloom.sources.tables import live_scan, scan
from vitaloom.streaming import frames, sinks

# --- five tables at once ---------------------------------------------------------------------------------------

_PARTS = ("chunks", "medications", "diagnoses", "labs", "allergies")


@register("tables_replaced_at_once", """WITH l AS (SELECT *, l_linenumber % 5 AS p FROM lineitem)
 SELECT list_extract(['chunks', 'medications', 'diagnoses', 'labs', 'allergies'], (p + 1)::INTEGER) AS part, l_orderkey, l_linenumber, l_quantity FROM l WHERE l_orderkey % 10 <> 0
 UNION ALL SELECT list_extract(['chunks', 'medications', 'diagnoses', 'labs', 'allergies'], (p + 1)::INTEGER), l_orderkey, 99, sum(l_quantity) FROM l WHERE l_orderkey % 10 = 0 AND p <> 2 GROUP BY ALL""")
def tables_replaced_at_once(spark, sf_dir):
    """Five tables keyed by order; every tenth order is made anew in one commit, with nothing in the third of them."""
    lines = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    part = lambda df, k: df.where(F.col("l_linenumber") % 5 == k)
    store = Snapshots(spark, fresh_folder(spark, "snapshots"), "l_orderkey", buckets=8)
    store.replace({t: part(lines, k) for k, t in enumerate(_PARTS)}, lines.select("l_orderkey"))
    again = lines.where("l_orderkey % 10 = 0")
    fresh = {t: part(again, k).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity")).select("l_orderkey", F.lit(99).cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"), "l_quantity") for k, t in enumerate(_PARTS)}
    fresh["diagnoses"] = fresh["diagnoses"].limit(0)
    store.replace(fresh, again.select("l_orderkey"))
    out = None
    for t, df in sorted(store.read_all().items()):
        df = df.select(F.lit(t).alias("part"), "l_orderkey", "l_linenumber", "l_quantity")
        out = df if out is None else out.unionByName(df)
    return out


# --- files of owners -------------------------------------------------------------------------------------------


@register("files_of_owners", """SELECT 'user_' || page_id % 7 || '/page_' || page_id || '.html' AS path, 'user_' || page_id % 7 AS owner, strlen(html) AS length, sha256(html) AS sha
 FROM pages WHERE page_id % 7 <> 5 AND page_id % 10 <> 3""")
def files_of_owners(spark, sf_dir):
    """Pages stored as files of seven owners, of which one leaves; a tenth of all files is deleted, and what is refused is not."""
    root = fresh_folder(spark, "files").removeprefix("file:")
    pages = scan(spark, sf_dir, "pages", "page_id", F.concat(F.lit("user "), F.col("page_id") % 7).alias("owner"), F.concat(F.lit("page "), F.col("page_id"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    kept = filestore.saved(pages, root)
    outside = kept.limit(1).select(F.concat(F.lit("../"), "path").alias("path"))
    filestore.deleted(kept.where("page_id % 10 = 3").select("path").union(outside), root).write.format("noop").mode("overwrite").save()
    filestore.deleted_owners(spark.createDataFrame([("user 5",)], "owner string"), root).write.format("noop").mode("overwrite").save()
    return filestore.files(spark, root).select("path", "owner", "length", F.sha2("content", 256).alias("sha"))


_MIMES = ("text/plain", "Text/CSV; charset=utf-16", "text/markdown", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/pdf", "application/msword", "video/mp4")
_MIME_SQL = "list_extract([" + ", ".join(f"'{m}'" for m in _MIMES) + "], (doc_id % 7)::INTEGER + 1)"


@register("texts_extracted", f"""WITH d AS (SELECT doc_id, doc_id % 7 AS k, text, {_MIME_SQL} AS mime FROM documents)
 SELECT doc_id, CASE k WHEN 2 THEN sha256('سلام ' || doc_id) WHEN 3 THEN sha256(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))) WHEN 4 THEN sha256('read ' || strlen(text)) WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text) END AS sha, CASE WHEN k = 4 THEN 80.0::DOUBLE END AS confidence,
 CASE k WHEN 5 THEN 'Legacy .doc files are not supported. Please re-save the document as .docx or export it as a PDF.' WHEN 6 THEN 'Unsupported file type: ' || mime END AS error FROM d""")
def texts_extracted(spark, sf_dir):
    """Documents as files of seven kinds, each read by its own branch; a stand-in reads what needs a hosted reader."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("k", F.pmod("doc_id", F.lit(7)))
    legacy = F.concat(F.unhex(F.lit("D3E1C7E320")), F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    raw = F.when(F.col("k") == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("k") == 2, legacy).otherwise(F.encode("text", "UTF-8"))
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("k") + 1).cast("int"))
    files = d.select("doc_id", "k", mime.alias("mime"), raw.alias("raw"))
    word = files.where("k = 3").mapInPandas(_as_docx, files.schema)
    pdf = lambda df, c: df.withColumns({"text": F.concat(F.lit("read "), F.octet_length(c)), "confidence": F.lit(80.0)})
    out = tables.extracted(files.where("k <> 3").unionByName(word), "mime", "raw", "doc_id", readers={"pdf": pdf})
    return out.select("doc_id", F.sha2("text", 256).alias("sha"), "confidence", "error")


def _as_docx(batches):
    """Texts as word-processor files, a paragraph a line."""
    for b in batches:
        made = []
        for raw in b["raw"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", "<w:document><w:body>" + "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in bytes(raw).decode().split("\n")) + "</w:body></w:document>")
            made.append(out.getvalue())
        yield b.assign(raw=made)


@register("files_processed_once", "SELECT 'user_' || page_id % 7 || '/page_' || page_id || '.html' AS path, strlen(html) AS length, 1::BIGINT AS times FROM pages")
def files_processed_once(spark, sf_dir):
    """The queue of arriving files, asked twice: each file is processed once."""
    root = fresh_folder(spark, "queue").removeprefix("file:")
    pages = scan(spark, sf_dir, "pages", F.concat(F.lit("user "), F.col("page_id") % 7).alias("owner"), F.concat(F.lit("page "), F.col("page_id"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    filestore.saved(pages, f"{root}/files")

    def process(batch, batch_id):
        batch.select("path", "length").write.mode("overwrite").parquet(f"{root}/done/batch={batch_id}")

    for _ in range(2):
        sinks.arriving_files(spark, f"{root}/files/*", process, f"{root}/checkpoint").awaitTermination()
    done = spark.read.schema("path string, length long").parquet(f"{root}/done")
    return done.groupBy(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("path"), "length").agg(F.count("*").alias("times"))


@register("turns_appended", "SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'doc' || conv_id END AS sources FROM conversations")
def turns_appended(spark, sf_dir):
    """Turns streamed to their table, without sources where there are none."""
    root = fresh_folder(spark, "turns")
    live = live_scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    sources = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.array(F.concat(F.lit("doc"), "conv_id"))).otherwise(F.array().cast("array<string>"))
    turns = sinks.turns(live.withColumn("sources", sources))
    sinks.appended(turns, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(turns.schema).parquet(f"{root}/table").select("conv_id", "turn", "role", "text", F.array_join("sources", "|").alias("sources"))


@register("insert_repeated", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def insert_repeated(spark, sf_dir):
    """Two jobs that append to one table, one of which runs again: nothing doubles."""
    path = f"{fresh_folder(spark, 'inserts')}/orders"
    o = scan(spark, sf_dir, "orders", "o_orderkey", F.when(F.pmod("o_orderkey", F.lit(4)) > 0, F.col("o_orderstatus")).alias("status"))
    for job in (0, 1, 0):
        records.inserted(o.where(F.pmod("o_orderkey", F.lit(2)) == job), {"status": "pending"}, path, job=f"part{job}")
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "status")


# --- frames ----------------------------------------------------------------------------------------------------

_FRAME_SQL = """to_json({'user': user_id, 'type': event_type, 'at': epoch_us(ts)})"""


def _framed(events):
    body = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return events.select("user_id", "event_id", sinks.frame(body).alias("frame"))


@register("frames_reassembled", f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS place, {_FRAME_SQL}::VARCHAR AS payload FROM events")
def frames_reassembled(spark, sf_dir):
    """Every user's frames as one run of bytes with the closing frame, cut into pieces of seven bytes and put together again."""
    framed = _framed(scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "")
    whole = framed.groupBy("user_id").agg(F.encode(F.concat(run, F.lit(sinks.LAST_FRAME)), "UTF-8").alias("raw"))
    cuts = whole.select("user_id", "raw", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / 7).cast("int"))).alias("cut"))
    pieces = cuts.select("user_id", "cut", F.substring("raw", F.col("cut") * 7 + 1, F.lit(7)).alias("content"))
    return frames.reassembled(pieces, "user_id", "cut")


@register("frames_through_sink", f"SELECT {_FRAME_SQL}::VARCHAR AS payload, count(*) AS n FROM events GROUP BY 1")
def frames_through_sink(spark, sf_dir):
    """Events streamed to the sink of frames, read back from its committed files and put together."""
    root = fresh_folder(spark, "frames").removeprefix("file:")
    live = _framed(live_scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))
    frames.sent(live, f"{root}/sink", f"{root}/checkpoint").awaitTermination()
    held = frames.in_pieces(frames.received(spark, f"{root}/sink"))
    return frames.reassembled(held, "name", "piece").groupBy("payload").agg(F.count("*").alias("n"))
