"""Queries over records, listings, parameters, providers and catalogues, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars
from vitaloom.operators import linking, pipelines, providers, records, relational, safety, trends
from vitaloom.plans import catalogues as cat
from vitaloom.plans import fixtures as fx
from vitaloom.plans.catalogue import register
from vitaloom.sources import tables
from vitaloom.sources.tables import scan
from vitaloom.streaming import limits

# --- sources ---------------------------------------------------------------------------------------------------


@register("point_lookup", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2")
def point_lookup(spark, sf_dir):
    return tables.look_up(scan(spark, sf_dir, "nation"), "n_nationkey", 7, "n_regionkey", 2).select("n_nationkey", "n_name")


@register("decode_text", "SELECT doc_id, sha256(text) AS digest FROM documents")
def decode_text(spark, sf_dir):
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode("text", charset))
    k = F.pmod("doc_id", F.lit(4))
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, marked("EFBBBF", "UTF-8")).when(k == 2, marked("FFFE", "UTF-16LE")).otherwise(marked("FEFF", "UTF-16BE"))
    return scan(spark, sf_dir, "documents", "doc_id", raw.alias("raw")).select("doc_id", F.sha2(tables.decoded_text(F.col("raw")), 256).alias("digest"))


@register(
    "uploads_accepted",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'docx' WHEN 3 THEN 'text' WHEN 4 THEN 'text' END AS kind FROM events
 WHERE event_id % 6 <> 5 AND (event_id * 7919) % 20971600 BETWEEN 1 AND 20971520""",
)
def uploads_accepted(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("PDF", "jpeg", "docx", "csv", "md", "exe"))), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    e = scan(spark, sf_dir, "events", "event_id")
    files = e.select(F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit("."), ext).alias("path"), F.pmod(F.col("event_id") * 7919, F.lit(20971600)).alias("length"), F.lit(None).cast("binary").alias("content"))
    return tables.accepted(files).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("event_id"), "kind")


# --- lists and points ------------------------------------------------------------------------------------------


@register("insights_listed", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def insights_listed(spark, sf_dir):
    return relational.listing(scan(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", F.col("place").cast("long"))


@register("share_links_listed", "SELECT user_id, event_id, ts <= TIMESTAMP '2024-02-01' AS expired FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 100")
def share_links_listed(spark, sf_dir):
    links = relational.listing(scan(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.asc("event_id")], 100)
    return links.select("user_id", "event_id", pipelines.expired(F.col("ts"), "2024-02-01").alias("expired"))


@register("trend_points", "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place FROM events")
def trend_points(spark, sf_dir):
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts")
    return trends.points(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", F.col("place").cast("long"))


@register("chart_domain", "SELECT user_id, event_type, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL")
def chart_domain(spark, sf_dir):
    return trends.domain(scan(spark, sf_dir, "events", "user_id", "event_type", "value"), ["user_id", "event_type"], "value")


@register("queue_counts", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey")
def queue_counts(spark, sf_dir):
    return relational.counted_in(scan(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", ["O", "P"])


# --- values ----------------------------------------------------------------------------------------------------


@register("abnormal_flag", "SELECT event_id, coalesce(CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, value < 10 OR value > 60, false) AS abnormal FROM events")
def abnormal_flag(spark, sf_dir):
    given = F.when(F.pmod("event_id", F.lit(3)) == 0, True).when(F.pmod("event_id", F.lit(3)) == 1, False)
    flag = scalars.abnormal(given, F.col("value"), scalars.reference_range(F.lit("10-60")))
    return scan(spark, sf_dir, "events", "event_id", flag.alias("abnormal"))


@register("confidence_clamp", "SELECT event_id, coalesce(least(100, greatest(0, round(CASE WHEN event_id % 5 > 0 THEN value * 2 - 20 END)::INTEGER)), 70) AS confidence FROM events")
def confidence_clamp(spark, sf_dir):
    v = F.when(F.pmod("event_id", F.lit(5)) > 0, F.col("value") * 2 - 20)
    return scan(spark, sf_dir, "events", "event_id", scalars.confidence(v, 70).alias("confidence"))


@register("clamped_text", "SELECT p_partkey, nullif(left(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END, 12), '') AS name FROM part")
def clamped_text(spark, sf_dir):
    return scan(spark, sf_dir, "part", "p_partkey", scalars.clamped(F.when(F.pmod("p_partkey", F.lit(9)) == 0, "").otherwise(F.col("p_name")), 12).alias("name"))


@register("urdu_present", rf"SELECT conv_id, turn, regexp_matches(text, '{fixed.URDU_LETTERS}') AS urdu FROM conversations UNION ALL SELECT -1, id, regexp_matches(raw, '{fixed.URDU_LETTERS}') FROM {fx.SCRIPTS.sql}")
def urdu_present(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", F.col("turn").cast("long"), "text").unionByName(fx.SCRIPTS.df(spark).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), F.col("raw").alias("text")))
    return c.select("conv_id", "turn", scalars.has_urdu(F.col("text")).alias("urdu"))


@register("lexical_content", r"SELECT item_id, regexp_matches(left(text, item_id % 3 + 1), '[\p{L}\p{N}]{2,}') AS searchable FROM benchmark")
def lexical_content(spark, sf_dir):
    return scan(spark, sf_dir, "benchmark", "item_id", scalars.has_words(F.left("text", (F.pmod("item_id", F.lit(3)) + 1).cast("int"))).alias("searchable"))


@register("safe_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 AND year(o_orderdate) <= 1997 THEN o_orderdate::DATE END AS day FROM orders")
def safe_dates(spark, sf_dir):
    said = F.lit("soon")
    for k, f in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy", "yyyy/MM/dd", "MMM d, yyyy")):
        said = F.when(F.pmod("o_orderkey", F.lit(6)) == k, F.date_format("o_orderdate", f)).otherwise(said)
    return scan(spark, sf_dir, "orders", "o_orderkey", scalars.safe_day(said, 1996).alias("day"))


@register("iso_days", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_days(spark, sf_dir):
    return scan(spark, sf_dir, "events", "event_id", scalars.iso_day(F.col("ts")).alias("day"))


@register("summary_languages", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ur' ELSE c_mktsegment END AS language FROM customer")
def summary_languages(spark, sf_dir):
    wish = F.element_at(F.array(F.lit("en"), F.lit("ur"), F.lit("auto")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    return scan(spark, sf_dir, "customer", "c_custkey", pipelines.summary_language(wish, F.col("c_mktsegment")).alias("language"))


@register(
    "parameter_bounds",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN (o_orderkey % 7) || '.5' ELSE (o_orderkey % 160 - 20)::VARCHAR END AS said, o_orderpriority AS q FROM orders)
 SELECT o_orderkey, CASE WHEN said IS NULL THEN 50 WHEN o_orderkey % 5 > 2 AND o_orderkey % 160 - 20 BETWEEN 1 AND 100 THEN (o_orderkey % 160 - 20)::INTEGER END AS page, said IS NULL OR (o_orderkey % 5 > 2 AND o_orderkey % 160 - 20 BETWEEN 1 AND 100) AS valid,
  CASE WHEN length(trim(q)) BETWEEN 1 AND 8 THEN trim(q) END AS search FROM p""",
)
def parameter_bounds(spark, sf_dir):
    k = F.pmod("o_orderkey", F.lit(5))
    said = F.when(k == 1, "many").when(k == 2, F.concat(F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit(".5"))).when(k > 2, (F.pmod("o_orderkey", F.lit(160)) - 20).cast("string"))
    page = scalars.bounded_int(said, 1, 100, 50)
    o = scan(spark, sf_dir, "orders", "o_orderkey", page.alias("p"), scalars.bounded_text(F.col("o_orderpriority"), 1, 8).alias("s"))
    return o.select("o_orderkey", F.col("p.value").alias("page"), "p.valid", F.col("s.value").alias("search"))


_FAILED = fx.Rows("id int, kind string, suggested double", (0, "rate_limit", 12.2), (1, "rate_limit", 389.664), (2, "rate_limit", None), (3, "transient", None), (4, "permanent", None), (5, "transient", 45.0))


@register(
    "retry_waits",
    f"""SELECT id, kind, suggested, a::INTEGER AS attempt, CASE WHEN kind = 'permanent' OR a = 4 OR suggested > 45 THEN NULL WHEN suggested IS NOT NULL THEN (ceil(suggested * 1000) + 250)::INTEGER
 ELSE CASE a WHEN 0 THEN 1000 WHEN 1 THEN 4000 ELSE 10000 END END AS wait_ms FROM {_FAILED.over_sql()}, range(5) r(a)""",
)
def retry_waits(spark, sf_dir):
    f = _FAILED.over(spark, sf_dir).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return f.withColumn("wait_ms", scalars.retry_wait(F.col("kind"), F.col("suggested"), F.col("attempt"), 5))


# --- writes ----------------------------------------------------------------------------------------------------


@register("insert_returning", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE o_orderstatus END AS status, 'General' AS section FROM orders")
def insert_returning(spark, sf_dir):
    o = scan(spark, sf_dir, "orders", "o_orderkey", F.when(F.pmod("o_orderkey", F.lit(4)) > 0, F.col("o_orderstatus")).alias("status"))
    return records.inserted(o, {"status": "pending", "section": "General"})


@register(
    "interaction_audit",
    """WITH f AS (SELECT user_id, CASE WHEN value > 90 THEN 4 WHEN value > 60 THEN 3 WHEN value > 40 THEN 2 ELSE 1 END AS s FROM events WHERE event_type = 'purchase')
 SELECT u.user_id, count(s) AS findings, CASE max(s) WHEN 4 THEN 'severe' WHEN 3 THEN 'moderate' WHEN 2 THEN 'mild' ELSE 'info' END AS severity FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id) GROUP BY u.user_id""",
)
def interaction_audit(spark, sf_dir):
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "value")
    level = F.when(F.col("value") > 90, "severe").when(F.col("value") > 60, "moderate").when(F.col("value") > 40, "mild")
    return safety.audit_rows(e.select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id", level.alias("severity")), "user_id", "severity").select("user_id", "findings", "severity")


@register("stalled_marked", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 15 MINUTE THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'completed' END AS status FROM orders")
def stalled_marked(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed")
    o = scan(spark, sf_dir, "orders", "o_orderkey", status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("started_at"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("string").alias("note"))
    return limits.swept(o, "1997-01-01", minutes=15).select("o_orderkey", "status")


@register("json_list_columns", "SELECT conv_id, to_json(list_sort(list(role)))::VARCHAR AS stored, count(*) AS n FROM conversations GROUP BY conv_id")
def json_list_columns(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(records.stored_list(F.array_sort(F.collect_list("role"))).alias("stored"))
    return c.withColumn("n", F.size(records.loaded_list(F.col("stored"))).cast("long"))


_DIGESTS = fx.Rows(
    "id int, raw string",
    (0, '{"title":" Weekly ","digest":"All well.","findings":[{"category":"labs","title":"HbA1c up","detail":" high ","priority":"attention"},{"category":"odd","title":"x"}],"priority":"elevated"}'),
    (1, '{"title":"","digest":7,"findings":[{"category":"labs"}],"priority":"soon"}'),
    (2, '{"title":"T","findings":"none"}'),
    (3, "not json"),
    (4, None),
    (5, '{"findings":[{"title":"a","priority":5,"detail":3}]}'),
    (6, '{"title":{"a":1},"digest":" ","findings":[],"priority":null}'),
)


@register(
    "digest_defaults",
    f"""WITH j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM {_DIGESTS.over_sql()}),
 t AS (SELECT id, v, CASE WHEN json_type(v, '$.title') = 'VARCHAR' THEN trim(v ->> '$.title') END AS t, CASE WHEN json_type(v, '$.digest') = 'VARCHAR' THEN trim(v ->> '$.digest') END AS d, CASE WHEN json_type(v, '$.findings') = 'ARRAY' THEN json_extract(v, '$.findings[*]') END AS f FROM j)
 SELECT id, coalesce(nullif(t, ''), 'Health insight digest') AS title, coalesce(nullif(d, ''), 'No summary generated.') AS digest,
  CASE WHEN v ->> '$.priority' IN ('normal', 'elevated', 'urgent') THEN v ->> '$.priority' END AS priority,
  CASE WHEN f IS NULL OR len(list_filter(f, lambda x: coalesce(json_type(x, '$.title') <> 'VARCHAR', true))) > 0 THEN '' ELSE array_to_string(list_transform(f, lambda x:
   CASE WHEN x ->> '$.category' IN ('medications', 'labs', 'diagnoses', 'allergies', 'general') THEN x ->> '$.category' ELSE 'general' END || ':' || trim(x ->> '$.title') || ':' || CASE WHEN json_type(x, '$.detail') = 'VARCHAR' THEN trim(x ->> '$.detail') ELSE '' END || ':' ||
   CASE WHEN x ->> '$.priority' IN ('info', 'attention', 'action_needed') THEN x ->> '$.priority' ELSE 'info' END), '|') END AS findings FROM t""",
)
def digest_defaults(spark, sf_dir):
    d = _DIGESTS.over(spark, sf_dir).select("id", records.digest(F.col("raw")).alias("d"))
    each = F.transform("d.findings", lambda f: F.concat_ws(":", f["category"], f["title"], f["detail"], f["priority"]))
    return d.select("id", "d.title", "d.digest", "d.priority", F.array_join(each, "|").alias("findings"))


_VOICES = fx.Rows(
    "id int, raw string",
    (0, '{"documentType":"lab_report","title":" Sugar ","description":" high ","medications":[{"name":" Metformin ","dosage":"500 mg"},{"name":"Aspirin","frequency":" od "}],"symptoms":[" thirst ","fatigue"],"date":"today","conditions":["diabetes"]}'),
    (1, '{"documentType":"poem","title":"","description":7,"medications":[{"name":"Metformin"},{"dosage":"5 mg"}],"symptoms":["ok",""],"hospital":"  City  "}'),
    (2, '{"title":"T","medications":[{"name":"A","dosage":null}],"symptoms":"none","conditions":[1]}'),
    (3, "not json"), (4, None), (5, "[]"), (6, "{}"), (7, '{"drugs":["Panadol"," "],"foods":[" grapefruit "],"supplements":[3],"medications":[]}'),
)
_LIST_SQL = """CASE WHEN json_type(v, '$.{0}') = 'ARRAY' AND len(list_filter(json_extract(v, '$.{0}[*]'), lambda x: json_type(x) <> 'VARCHAR' OR trim(x ->> '$') = '')) = 0 THEN array_to_string(list_transform(json_extract(v, '$.{0}[*]'), lambda x: trim(x ->> '$')), '|') ELSE '' END"""
_TEXT_SQL = "CASE WHEN json_type(v, '$.{0}') = 'VARCHAR' THEN trim(v ->> '$.{0}') END"


@register(
    "voice_entries",
    f"""WITH j AS (SELECT id, v FROM (SELECT id, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM {_VOICES.over_sql()}) WHERE json_type(v) = 'OBJECT')
 SELECT id, CASE WHEN v ->> '$.documentType' IN ({", ".join(f"'{t}'" for t in records.DOCUMENT_TYPES)}) THEN v ->> '$.documentType' ELSE 'voice_entry' END AS kind, coalesce(nullif({_TEXT_SQL.format("title")}, ''), 'Voice note') AS title, coalesce({_TEXT_SQL.format("description")}, '') AS description,
  CASE WHEN json_type(v, '$.medications') = 'ARRAY' AND len(list_filter(json_extract(v, '$.medications[*]'), lambda x: coalesce(json_type(x, '$.name') <> 'VARCHAR', true) OR trim(x ->> '$.name') = '' OR coalesce(json_type(x, '$.dosage') <> 'VARCHAR', false) OR coalesce(json_type(x, '$.frequency') <> 'VARCHAR', false))) = 0
   THEN array_to_string(list_transform(json_extract(v, '$.medications[*]'), lambda x: trim(x ->> '$.name') || ':' || coalesce(trim(x ->> '$.dosage'), '') || ':' || coalesce(trim(x ->> '$.frequency'), '')), '|') ELSE '' END AS medications,
  {_LIST_SQL.format("symptoms")} AS symptoms, {_LIST_SQL.format("conditions")} AS conditions, {_TEXT_SQL.format("date")} AS date, {_TEXT_SQL.format("hospital")} AS hospital FROM j""",
)
def voice_entries(spark, sf_dir):
    v = _VOICES.over(spark, sf_dir).select("id", records.voice_entry(F.col("raw")).alias("v")).where("v IS NOT NULL")
    meds = F.array_join(F.transform("v.medications", lambda m: F.concat(m["name"], F.lit(":"), F.coalesce(m["dosage"], F.lit("")), F.lit(":"), F.coalesce(m["frequency"], F.lit("")))), "|")
    return v.select("id", F.col("v.documentType").alias("kind"), "v.title", "v.description", meds.alias("medications"), F.array_join("v.symptoms", "|").alias("symptoms"), F.array_join("v.conditions", "|").alias("conditions"), "v.date", "v.hospital")


@register("asked_entities", f"WITH j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM {_VOICES.over_sql()}) SELECT id, {_LIST_SQL.format('drugs')} AS drugs, {_LIST_SQL.format('foods')} AS foods, {_LIST_SQL.format('supplements')} AS supplements FROM j")
def asked_entities(spark, sf_dir):
    v = _VOICES.over(spark, sf_dir).select("id", records.asked_entities(F.col("raw")).alias("v"))
    return v.select("id", *(F.array_join(f"v.{n}", "|").alias(n) for n in ("drugs", "foods", "supplements")))


# --- summary ---------------------------------------------------------------------------------------------------


@register(
    "summary_medications",
    """WITH m AS (SELECT o_custkey, l_orderkey, l_linenumber, '  - ' || 'part ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_linenumber ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ', ' || l_returnflag END || CASE l_linestatus WHEN 'F' THEN ' (inactive)' ELSE '' END AS line
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT o_custkey, count(*) AS n, string_agg(line, chr(10) ORDER BY l_orderkey, l_linenumber, line) AS lines FROM m GROUP BY o_custkey)
 SELECT c_custkey AS owner, 'Medications (' || coalesce(n, 0) || '):' || chr(10) || coalesce(lines, '  None recorded') AS section FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
)
def summary_medications(spark, sf_dir):
    n = F.col("l_linenumber")
    line = pipelines.medication_line(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.when(n % 2 == 0, n.cast("string")), F.when(n % 3 == 0, "").otherwise(F.col("l_returnflag")), F.when(F.col("l_linestatus") == "F", False))
    owners = scan(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    rows = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").join(owners, "l_orderkey")
    return pipelines.summary_section(scan(spark, sf_dir, "customer", F.col("c_custkey").alias("owner")), rows, "owner", "Medications", line, ["l_orderkey", "l_linenumber"])


@register(
    "summary_labs",
    """WITH m AS (SELECT user_id, event_id, ts, '  - ' || event_type || ': ' || (event_id % 50) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' mg/dL' END || CASE WHEN value > 60 THEN ' [ABNORMAL]' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' (ref: 4-40)' END AS line FROM events)
 SELECT user_id AS owner, 'Lab Results (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) ORDER BY ts, event_id, line) AS section FROM m GROUP BY user_id""",
)
def summary_labs(spark, sf_dir):
    i = F.col("event_id")
    line = pipelines.lab_line(F.col("event_type"), (i % 50).cast("string"), F.when(i % 4 > 0, "mg/dL"), F.col("value") > 60, F.when(i % 3 > 0, "4-40"))
    e = scan(spark, sf_dir, "events", F.col("user_id").alias("owner"), "event_id", "event_type", "ts", "value")
    return pipelines.summary_section(e.select("owner").distinct(), e, "owner", "Lab Results", line, ["ts", "event_id"])


# --- providers -------------------------------------------------------------------------------------------------


@register("looked_up_once", "SELECT p_partkey, lower(p_brand) AS concept FROM part")
def looked_up_once(spark, sf_dir):
    p = scan(spark, sf_dir, "part", "p_partkey", "p_brand")
    return providers.looked_up_once(p, "p_brand", lambda k: k.withColumn("concept", F.lower("p_brand"))).select("p_partkey", "concept")


@register("bounded_calls", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def bounded_calls(spark, sf_dir):
    def call(batches):
        for b in batches:
            yield b.assign(n=b["text"].str.len().astype("Int64")).drop(columns="text")

    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    kinds = dict(c.dtypes)
    return providers.called(c, 4, call, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, n long", "conv_id", "turn")


_ASKED = fx.Rows("id int, name string, rxcui string", (0, "Metformin ", None), (1, "Metformin", "6809"), (2, "aspirin", None), (3, "Zzyzx", None), (4, "Amlodipine", " "), (5, "Panadol", "161"), (6, "", "161"))
_CONCEPTS = fx.Rows("rxcui string, name string, made string", ("6809", "metformin", "metformin"), ("1191", "Aspirin", ""), ("17767", "amlodipine", "amlodipine besylate"), ("161", "paracetamol", ""))


@register(
    "concept_resolution",
    f"""WITH a AS (SELECT trim(name) AS name, max(nullif(trim(rxcui), '')) AS given FROM {_ASKED.over_sql()} WHERE trim(name) <> '' GROUP BY 1), c AS (SELECT * FROM {_CONCEPTS.sql}),
 k AS (SELECT a.name, coalesce(given, (SELECT c.rxcui FROM c WHERE lower(c.name) = lower(a.name))) AS rxcui FROM a)
 SELECT k.name, k.rxcui, CASE WHEN k.rxcui IS NULL THEN '' ELSE coalesce(nullif(c.made, ''), lower(k.name)) END AS ingredients FROM k LEFT JOIN c USING (rxcui)""",
)
def concept_resolution(spark, sf_dir):
    concepts = _CONCEPTS.df(spark).select("rxcui", "name", F.when(F.col("made") == "", F.array().cast("array<string>")).otherwise(F.array("made")).alias("ingredients"), F.array().cast("array<string>").alias("classes"))
    return safety.resolved(_ASKED.over(spark, sf_dir), concepts).select("name", "rxcui", F.array_join("ingredients", "|").alias("ingredients"))


# --- catalogues ------------------------------------------------------------------------------------------------

_SYNONYMS = fx.Rows("key string, ordinal int, s string", *[(a[0], k, s) for k, a in enumerate(cat.ANALYTES) for s in (*a[5], a[1])])
#: Names as reports write them: every document has one of all of them.
_REPORTED = fx.Rows("doc_id int, s string", *enumerate(r[2] for r in _SYNONYMS.rows))
#: How a name stands on a report: before it and after it.
_AROUND = fx.Rows("k int, before string, after string", *[(k, *r) for k, r in enumerate([("", ""), ("Serum ", ""), ("", " level (fasting)"), ("S. ", ":"), ("", " mg/dl"), ("", " hydroxide prep"), ("total count of ", ""), ("odd ", " manual")])])


def _said_around(named, around, spark, sf_dir):
    """doc_id, what a document says of one thing, with one of the frames around it."""
    return named.over(spark, sf_dir).withColumn("k", F.pmod(F.floor(F.col("doc_id") / 3), F.lit(around.keys())).cast("int")).join(around.df(spark), "k")


def _said_around_sql(named, around):
    return f"(SELECT f.*, a.before, a.after FROM {named.over_sql()} JOIN {around.sql.replace('AS f(', 'AS a(')} ON (f.doc_id // 3) % {around.keys()} = a.k)"
_COMPARABLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\(.*?\)', ' ', 'g'), '[^\p{{L}}\p{{N}}%^/]+', ' ', 'g'), '\b(?:serum|plasma|blood|s|p|test|level|levels|conc|concentration)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@register(
    "analyte_catalogue",
    f"""WITH syn AS (SELECT key, ordinal, {_COMPARABLE.format("s")} AS name FROM {_SYNONYMS.sql}), idx AS (SELECT name, max(ordinal) AS ordinal, arg_max(key, ordinal) AS key FROM syn WHERE name <> '' GROUP BY name),
 docs AS (SELECT doc_id, before || s || after AS name FROM {_said_around_sql(_REPORTED, _AROUND)}), raw AS (SELECT DISTINCT name FROM docs), n AS (SELECT name, {_COMPARABLE.format("name")} AS c FROM raw),
 near AS (SELECT n.name, i.key FROM n JOIN idx i ON length(i.name) >= 3 AND contains(' ' || n.c || ' ', ' ' || i.name || ' ') AND length(i.name) >= 0.6 * length(n.c) QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY length(i.name) DESC, i.ordinal) = 1)
 SELECT docs.doc_id, n.name, coalesce(i.key, near.key) AS key FROM docs JOIN n ON n.name = docs.name LEFT JOIN idx i ON i.name = n.c LEFT JOIN near ON near.name = n.name""",
)
def analyte_catalogue(spark, sf_dir):
    names = _said_around(_REPORTED, _AROUND, spark, sf_dir).select("doc_id", F.concat("before", "s", "after").alias("name"))
    return linking.link_analytes(names, cat.analytes(spark), "name").select("doc_id", "name", "key")


_FACTORS = fx.Rows("doc_id int, display string, canonical string, unit string, factor double", *[(k, *r) for k, r in enumerate((a[1], a[3], u, f) for a in cat.ANALYTES for u, f in a[4].items())])


# a unit that begins with "per" reads as a rate, so "percent" is none that the catalogue converts
@register("analyte_units", f"SELECT doc_id, display AS name, unit, CASE WHEN unit NOT LIKE 'per%' THEN round((doc_id % 1000 + 0.5) * factor, 4) END AS value, canonical FROM {_FACTORS.over_sql()}")
def analyte_units(spark, sf_dir):
    labs = _FACTORS.over(spark, sf_dir).select("doc_id", F.col("display").alias("name"), F.upper("unit").alias("said"), "unit", "canonical", (F.col("doc_id") % 1000 + 0.5).alias("v"))
    return linking.canonical_labs(labs, cat.analytes(spark), "name", "v", "said").select("doc_id", "name", "unit", F.round("canonical_value", 4).alias("value"), "canonical")


_NAMES = fx.Rows("code string, canonical string, ordinal int, p int, e string", *[(c, n, k, p, e) for k, (c, n, aliases) in enumerate(cat.CONDITIONS) for p, e in enumerate((n, *aliases))])
_WRITTEN = fx.Rows("doc_id int, e string", *enumerate(r[4] for r in _NAMES.rows))
_SAID = fx.Rows("k int, before string, after string", *[(k, *r) for k, r in enumerate([("", ""), ("Known case of uncontrolled ", ""), ("", " (severe)"), ("h/o ", ", stage II"), ("patient seen with ", " and swelling"), ("no mention of any such ", " in these long and winding notes of the visit")])])
_NOISE = r"\b(?:known case of|known|k/c/o|diagnosed(?: with)?|history of|h/o|c/o|complains? of|suspected|probable|possible|uncontrolled|controlled|poorly controlled|newly diagnosed|old|longstanding|mild|moderate|severe|stage \w+|grade \w+|left|right|bilateral|primary|secondary|essential)\b"
_PLAIN = (
    "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '" + _NOISE + "', ' ', 'g'), '[(),.;:''\"\\[\\]{{}}]', ' ', 'g'), '[-–—/]', ' ', 'g'), '" + _NOISE + "', ' ', 'g'), '\\s+', ' ', 'g')), ' '),"
    " lambda w: CASE w WHEN 'i' THEN '1' WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'iv' THEN '4' ELSE w END), ' ')"
)


@register(
    "condition_catalogue",
    f"""WITH docs AS (SELECT doc_id, before || e || after AS raw FROM {_said_around_sql(_WRITTEN, _SAID)}), e AS (SELECT *, {_PLAIN.format("e")} AS name FROM {_NAMES.sql}), idx AS (SELECT * FROM e WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY p > 0, ordinal, p) = 1),
 n AS (SELECT raw, {_PLAIN.format("raw")} AS name FROM (SELECT DISTINCT raw FROM docs)),
 t AS (SELECT *, list_distinct(string_split(name, ' ')) AS ws FROM n), parts AS (SELECT *, list_distinct(string_split(name, ' ')) AS ws FROM e WHERE name <> ''),
 near AS (SELECT t.raw, p.code, CASE WHEN len(p.ws) = len(t.ws) THEN 'alias' ELSE 'partial' END AS matched_on FROM t JOIN parts p ON len(t.ws) <= 10 AND (len(p.ws) >= 2 OR length(p.name) >= 4) AND list_has_all(t.ws, p.ws)
  QUALIFY row_number() OVER (PARTITION BY t.raw ORDER BY len(p.ws) DESC, p.ordinal, p.name) = 1)
 SELECT docs.doc_id, n.raw, coalesce(i.code, near.code) AS code, CASE WHEN i.code IS NOT NULL THEN CASE WHEN i.p = 0 THEN 'exact' ELSE 'alias' END ELSE near.matched_on END AS matched_on FROM docs JOIN n ON n.raw = docs.raw LEFT JOIN idx i ON i.name = n.name LEFT JOIN near ON near.raw = n.raw""",
)
def condition_catalogue(spark, sf_dir):
    raw = _said_around(_WRITTEN, _SAID, spark, sf_dir).select("doc_id", F.concat("before", "e", "after").alias("raw"))
    return linking.link_conditions(raw, cat.conditions(spark), "raw").select("doc_id", "raw", "code", "matched_on")


_SPELLINGS = fx.Rows("english string, w string, ordinal int", *[(e, w, k) for k, (e, _, urdu, roman) in enumerate(cat.LEXICON) for w in (*urdu, *roman)])


#: Every spelling of the lexicon, and some that are spelt another way or are none.
_HEARD = fx.Rows("doc_id int, phrase string", *enumerate([*(r[1] for r in _SPELLINGS.rows), "khaansi", "khansee", "KHANSI", "bukhaarr", "qabzz", " dama ", "dm", "bp", "zzyzx", "pathree", "yaarkan", "", "12", "کھانسی test"]))
_KINDS = fx.Rows("english string, kind string", *[(e, k) for e, k, *_ in cat.LEXICON])


def _sound_sql(c: str) -> str:
    """The sound of a phrase in SQL: digraphs folded, repeats squeezed, inner vowels out, word by word."""
    s = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
    for a, b in fixed.DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    squeezed = lambda e: functools.reduce(lambda x, ch: f"regexp_replace({x}, '{ch}+', '{ch}', 'g')", "abcdefghijklmnopqrstuvwxyz", e)
    first = f"list_transform(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda w: {squeezed(s)})"
    second = f"list_transform({first}, lambda w: left(w, 1) || regexp_replace(substr(w, 2), '[aeiou]', '', 'g'))"
    return f"array_to_string(list_filter(list_transform({second}, lambda w: {squeezed('w')}), lambda w: w <> ''), ' ')"


_LOOKED_UP = f"""sp AS (SELECT english, ordinal, w, regexp_matches(w, '{fixed.URDU_LETTERS}') AS u, {_sound_sql("w")} AS p FROM {_SPELLINGS.sql}),
 ix AS (SELECT k, arg_min(english, ordinal) AS english FROM (SELECT 'l' || lower(w) AS k, english, ordinal FROM sp WHERE NOT u UNION ALL SELECT 'p' || p, english, ordinal FROM sp WHERE NOT u AND length(replace(p, ' ', '')) >= 3
  UNION ALL SELECT 'u' || translate(w, '{fixed.LETTER_FOLDING[0]}', '{fixed.LETTER_FOLDING[1]}'), english, ordinal FROM sp WHERE u) GROUP BY k)"""


@register(
    "lexicon_spellings",
    f"""WITH {_LOOKED_UP}, d AS (SELECT doc_id, phrase, regexp_matches(phrase, '{fixed.URDU_LETTERS}') AS u FROM {_HEARD.over_sql()}),
 n AS (SELECT DISTINCT phrase, CASE WHEN u THEN 'u' || translate(trim(phrase), '{fixed.LETTER_FOLDING[0]}', '{fixed.LETTER_FOLDING[1]}') ELSE 'l' || lower(trim(phrase)) END AS a, CASE WHEN NOT u THEN 'p' || {_sound_sql("phrase")} END AS b FROM d)
 SELECT d.doc_id, d.phrase, coalesce(x.english, y.english) AS english FROM d JOIN n ON n.phrase = d.phrase LEFT JOIN ix x ON x.k = n.a LEFT JOIN ix y ON y.k = n.b""",
)
def lexicon_spellings(spark, sf_dir):
    return linking.local_terms(_HEARD.over(spark, sf_dir), cat.lexicon(spark), "phrase").select("doc_id", "phrase", "english")


@register(
    "conditions_in_local_words",
    f"""WITH {_LOOKED_UP}, e AS (SELECT *, {_PLAIN.format("e")} AS name FROM {_NAMES.sql}), idx AS (SELECT * FROM e WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY p > 0, ordinal, p) = 1),
 d AS (SELECT doc_id, phrase, regexp_matches(phrase, '{fixed.URDU_LETTERS}') AS u FROM {_HEARD.over_sql()}),
 n AS (SELECT DISTINCT phrase, CASE WHEN u THEN 'u' || translate(trim(phrase), '{fixed.LETTER_FOLDING[0]}', '{fixed.LETTER_FOLDING[1]}') ELSE 'l' || lower(trim(phrase)) END AS a, CASE WHEN NOT u THEN 'p' || {_sound_sql("phrase")} END AS b, {_PLAIN.format("phrase")} AS name FROM d),
 l AS (SELECT n.phrase, n.name, coalesce(x.english, y.english) AS english FROM n LEFT JOIN ix x ON x.k = n.a LEFT JOIN ix y ON y.k = n.b),
 t AS (SELECT l.phrase, i.code AS exact_code, i.p, c.code AS local_code FROM l LEFT JOIN idx i ON i.name = l.name LEFT JOIN {_KINDS.sql.replace("AS f(", "AS k(")} ON k.english = l.english AND k.kind IN ('condition', 'symptom') LEFT JOIN idx c ON l.name <> '' AND c.name = k.english)
 SELECT d.doc_id, d.phrase, coalesce(exact_code, local_code) AS code, CASE WHEN exact_code IS NOT NULL THEN CASE WHEN p = 0 THEN 'exact' ELSE 'alias' END WHEN local_code IS NOT NULL THEN 'local-language' END AS matched_on
 FROM d JOIN t ON t.phrase = d.phrase WHERE exact_code IS NOT NULL OR local_code IS NOT NULL""",
)
def conditions_in_local_words(spark, sf_dir):
    """What is written in the local language, in script or romanised in any spelling, as conditions of the catalogue; what links by its English words alone is left out."""
    linked = linking.link_conditions(_HEARD.over(spark, sf_dir), cat.conditions(spark), "phrase", cat.lexicon(spark))
    return linked.where(F.col("matched_on").isin("exact", "alias", "local-language") & ~((F.col("matched_on") == "alias") & (F.col("confidence") < 0.95))).select("doc_id", "phrase", "code", "matched_on")


_QUESTIONS = fx.Rows("id int, q string", (0, "mujhe khansi aur bukhar hai"), (1, "shugar"), (2, "amlodipine"), (3, "fever and cough"), (4, "شوگر"), (5, ""), (6, None), (7, "bukhar phir bukhar"), (8, "khansee; dama?"))
_IN_ENGLISH = fx.Rows("id int, place int, english string", (0, 2, "cough"), (0, 4, "fever"), (1, 1, "diabetes"), (2, None, None), (3, None, None), (4, 1, "diabetes"), (5, None, None), (6, None, None), (7, 1, "fever"), (8, 1, "cough"))
_ADDED = fx.Rows("id int, added string", (0, "cough fever"), (1, "diabetes type mellitus"), (2, ""), (3, ""), (4, "diabetes type mellitus"), (5, ""), (6, ""), (7, "fever"), (8, "cough"))


@register("english_terms", f"SELECT id, place, english FROM {_IN_ENGLISH.over_sql()} WHERE place IS NOT NULL")
def english_terms(spark, sf_dir):
    """Every document asks one of the questions; the SQL states the terms of each."""
    return pipelines.english_terms(_QUESTIONS.over(spark, sf_dir), cat.lexicon(spark), "id", "q")


@register("question_expanded", f"SELECT id, added FROM {_ADDED.over_sql()}")
def question_expanded(spark, sf_dir):
    return pipelines.expanded(_QUESTIONS.over(spark, sf_dir), cat.lexicon(spark), cat.SYNONYMS, cat.conditions(spark), "id", "q").select("id", F.array_join("added", " ").alias("added"))
