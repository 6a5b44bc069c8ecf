"""Queries over whole flows, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaloom.functions import scalars
from vitaloom.operators import pipelines, providers, records, relational, safety
from vitaloom.plans import catalogues as cat
from vitaloom.plans import fixtures as fx
from vitaloom.plans.catalogue import register
from vitaloom.plans.text_queries import _CANDIDATES, DRUGS_ASKED_SQL, _drugs
from vitaloom.sources.tables import is_scanned, scan
from vitaloom.streaming import sinks


@register("hashed_embeddings", r"SELECT item_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE END AS norm, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 64 END AS dims FROM benchmark")
def hashed_embeddings(spark, sf_dir):
    e = providers.embedded(scan(spark, sf_dir, "benchmark", "item_id", "text"), "text")
    return e.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), F.size("embedding").alias("dims"))


_LOCAL = fx.Rows("id int, t string", (0, "خون کی کمی"), (1, "khoon ki kami aur bukhar"), (2, "red khoon"), (3, ""), (4, None), (5, "khansee, Dama; bukhaar/ulti"), (6, "12 khansi"), (7, "مریض کو شوگر ہے"))
_LOCAL_TERMS = fx.Rows("id int, place int, matched string, english string", (0, 1, "خون کی کمی", "anemia"), (1, 1, "khoon ki kami", "anemia"), (1, 5, "bukhar", "fever"), (2, 2, "khoon", "blood"), (3, None, None, None), (4, None, None, None),
                       (5, 1, "khansee", "cough"), (5, 2, "Dama", "asthma"), (5, 3, "bukhaar", "fever"), (5, 4, "ulti", "vomiting"), (6, 1, "12 khansi", "cough"), (7, 1, "مریض", "patient"), (7, 3, "شوگر", "diabetes"))


@register("local_terms_scan", f"SELECT id, place, matched, english FROM {_LOCAL_TERMS.over_sql()} WHERE place IS NOT NULL")
def local_terms_scan(spark, sf_dir):
    return pipelines.found_terms(_LOCAL.over(spark, sf_dir), cat.lexicon(spark), "id", "t").select("id", "place", "matched", "english")


_DIAGNOSES = fx.Rows("doc int, condition string, status string, canonical string, code string", (1, "T2DM", "present", "Type 2 diabetes mellitus", "E11.9"), (1, "Asthma", "absent", None, None), (1, "odd thing", "uncertain", "odd thing", None),
                     (2, "bad migraine headache", "historical", "Migraine", None), (2, "", "present", None, None), (3, "دمہ", "present", "Asthma", "J45.909"), (3, "pilia", "present", "Jaundice", "R17"), (3, "jigar", "present", "jigar", None))


@register("ingest_diagnosis_rows", f"SELECT doc, condition, canonical AS canonical_condition, code AS icd10_code, status FROM {_DIAGNOSES.over_sql()} WHERE condition <> '' AND status IN ('present', 'historical', 'uncertain')")
def ingest_diagnosis_rows(spark, sf_dir):
    return pipelines.diagnosis_rows(_DIAGNOSES.over(spark, sf_dir).select("doc", "condition", "status"), cat.conditions(spark), cat.lexicon(spark))


_MEDS = fx.Rows("doc long, name string, genericName string, dosage string, frequency string, duration string, route string, rxnormId string, isActive boolean", (1, "Metformin", "metformin", "500 mg", "bd", None, "oral", "6809", None), (1, "", "x", None, None, None, None, None, True), (2, "A" * 510, None, "B" * 260, None, "", "c" * 101, "9" * 51, False), (2, None, "y", None, None, None, None, None, None))


@register("ingest_medication_rows", f"""SELECT doc, left(name, 500) AS name, nullif(left(genericName, 500), '') AS genericName, nullif(left(dosage, 255), '') AS dosage, nullif(left(frequency, 255), '') AS frequency, nullif(left(duration, 255), '') AS duration,
 nullif(left(route, 100), '') AS route, nullif(left(rxnormId, 50), '') AS rxnormId, coalesce(isActive, true) AS isActive FROM {_MEDS.over_sql()} WHERE name <> ''""")
def ingest_medication_rows(spark, sf_dir):
    return pipelines.medication_rows(_MEDS.over(spark, sf_dir))


_LABS = fx.Rows("doc long, testName string, value string, numericValue double, unit string, referenceRange string, isAbnormal boolean", (1, "HbA1c", "7.4", None, "%", "4.0-5.6", None), (1, "Serum Creatinine", None, 88.4, "umol/L", None, None), (1, "FBS", "5.5", None, "mmol/L", "3.9-6.1", True), (2, "Widgetase", "12", None, "u", "1-20", None), (2, "", "5", None, None, None, None), (2, "ALT", None, None, "U/L", None, None))


@register("ingest_lab_rows", f"""WITH k AS (SELECT *, coalesce(value, numericValue::VARCHAR) AS v, coalesce(try_cast(value AS DOUBLE), numericValue) AS n FROM {_LABS.over_sql()} WHERE testName <> ''),
 r AS (SELECT *, try_cast(regexp_extract(referenceRange, '^([0-9.]+)-', 1) AS DOUBLE) AS lo, try_cast(regexp_extract(referenceRange, '-([0-9.]+)$', 1) AS DOUBLE) AS hi FROM k WHERE v IS NOT NULL),
 c AS (SELECT *, CASE testName WHEN 'HbA1c' THEN 'hba1c' WHEN 'Serum Creatinine' THEN 'creatinine' WHEN 'FBS' THEN 'glucose_fasting' WHEN 'ALT' THEN 'alt' END AS canonicalTestName, CASE testName WHEN 'HbA1c' THEN n WHEN 'Serum Creatinine' THEN n * (1 / 88.4) WHEN 'FBS' THEN n * 18.0182 END AS cv FROM r)
 SELECT doc, testName, canonicalTestName, round(cv, 6) AS canonical_value, CASE WHEN cv IS NOT NULL THEN CASE canonicalTestName WHEN 'hba1c' THEN '%' ELSE 'mg/dL' END END AS canonical_unit, v AS value, n AS numericValue, unit, referenceRange, coalesce(isAbnormal, n < lo OR n > hi, false) AS isAbnormal FROM c""")
def ingest_lab_rows(spark, sf_dir):
    return pipelines.lab_rows(_LABS.over(spark, sf_dir), cat.analytes(spark)).withColumn("canonical_value", F.round("canonical_value", 6))


_ALLERGIES = fx.Rows("doc long, allergen string, allergyType string, severity string, reaction string, assertionStatus string", (1, "Penicillin", "drug", "severe", "rash", None), (1, "Latex", None, None, None, "absent"), (2, "Dust", "env", "x" * 120, "sneezing", "historical"), (2, "", None, None, None, "present"), (3, "Nuts", None, None, None, "family"))


@register("ingest_allergy_rows", f"SELECT doc, left(allergen, 500) AS allergen, left(allergyType, 100) AS allergyType, left(severity, 100) AS severity, reaction, coalesce(assertionStatus, 'present') AS assertionStatus FROM {_ALLERGIES.over_sql()} WHERE allergen <> '' AND coalesce(assertionStatus, 'present') IN ('present', 'historical', 'uncertain')")
def ingest_allergy_rows(spark, sf_dir):
    return pipelines.allergy_rows(_ALLERGIES.over(spark, sf_dir))


def _history_sql(part, source, order, cap, where="true"):
    return f"SELECT owner, '{part}' AS part, id FROM ({source}) WHERE {where} QUALIFY row_number() OVER (PARTITION BY owner ORDER BY {order}) <= {cap}"


_OF_LINES = "SELECT o_custkey AS owner, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS day, l_linestatus, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_NEWEST = "day DESC NULLS FIRST, id"


@register(
    "history_five_reads",
    f"""WITH labs AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY {_NEWEST}) AS n FROM (SELECT user_id AS owner, event_id AS id, ts AS day, lower(event_type) AS name FROM events))
 {_history_sql("documents", "SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS day FROM orders", _NEWEST, 200)}
 UNION ALL {_history_sql("medications", _OF_LINES, _NEWEST, 60, "l_linestatus = 'O'")}
 UNION ALL {_history_sql("diagnoses", _OF_LINES, _NEWEST, 60, "l_returnflag = 'A'")}
 UNION ALL (SELECT owner, 'labs', id FROM labs WHERE n <= 200 QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY {_NEWEST}) = 1)
 UNION ALL {_history_sql("allergies", _OF_LINES, "id", 100, "l_returnflag = 'R'")}""",
)
def history_five_reads(spark, sf_dir):
    orders = scan(spark, sf_dir, "orders", F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    lines = scan(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("day"), "l_linestatus", "l_returnflag")
    lines = lines.join(orders.select("owner", "doc"), "doc")
    labs = scan(spark, sf_dir, "events", F.col("user_id").alias("owner"), F.col("event_id").alias("doc"), F.col("event_id").alias("id"), F.col("ts").alias("day"), F.col("event_type").alias("name"))
    tables = {"documents": orders, "medications": lines.withColumn("active", F.col("l_linestatus") == "O"), "diagnoses": lines.where("l_returnflag = 'A'"), "labs": labs, "allergies": lines.where("l_returnflag = 'R'")}
    return pipelines.history_summary(tables)


_NOTED = fx.Rows("doc int, text string", (0, "Denies asthma. Has hypertension. Tab Penicillin 250 mg bd given."), (1, "diabetes"), (2, "مریض کو شوگر نہیں ہے"), (3, "mujhe dama nahi hai. HbA1c 7.4, tab Amlodipin 5 mg od"), (4, None), (5, "Mother had asthma."))
_NOTED_DIAGNOSES = fx.Rows("doc int, place int, condition string, icd10Code string", (0, 0, "asthma", None), (0, 1, "hypertension", None), (1, 0, "diabetes", "E11.9"), (2, 0, "diabetes", None), (3, 0, "asthma", None), (4, 0, "asthma", None), (5, 0, "asthma", None))
_NOTED_DRUGS = fx.Rows("doc int, place int, name string, genericName string", (0, 0, None, None), (1, 0, None, None), (2, 0, None, None), (3, 0, "Amlodipin", None), (4, 0, None, None), (5, 0, "Aspirin", None))
_NOTED_ALLERGIES = fx.Rows("doc int, place int, allergen string", (0, 0, "Penicillin"), (1, 0, None), (2, 0, None), (3, 0, None), (4, 0, None), (5, 0, None))
_NOTED_LABS = fx.Rows("doc int, place int, testName string", *[(d, 0, None) for d in range(6)])
_RECONCILED = fx.Rows("doc int, missed string, held_back string, linked long, identified int, notes int", (0, "", "asthma", 2, 0, 1), (1, "", "", 0, 0, 0), (2, "", "diabetes", 1, 0, 1), (3, "HbA1c", "asthma", 1, 1, 3), (4, "", "", 1, 0, 0), (5, "", "asthma", 1, 0, 1))


@register("reconcile_records", f"SELECT doc, missed, held_back, linked, identified, notes FROM {_RECONCILED.over_sql()}")
def reconcile_records(spark, sf_dir):
    record = {"medications": _NOTED_DRUGS, "diagnoses": _NOTED_DIAGNOSES, "allergies": _NOTED_ALLERGIES, "labs": _NOTED_LABS}
    r = pipelines.reconciled(_NOTED.over(spark, sf_dir), {k: v.over(spark, sf_dir) for k, v in record.items()}, cat.conditions(spark), cat.lexicon(spark), cat.spellings(), _CANDIDATES.df(spark))
    return r.select("doc", F.array_join("missed", "|").alias("missed"), F.array_join("held_back", "|").alias("held_back"), "linked", "identified", F.size("notes").alias("notes"))


_CHECKED = """WITH d AS (SELECT drug, string_split(drug, ' ')[1] AS n FROM (SELECT DISTINCT drug FROM ({drugs})))
 SELECT drug, 0 AS place, 'allergy' AS kind, CASE n WHEN 'amoxicillin' THEN 'Penicillins' ELSE 'Aspirin' END AS item, CASE n WHEN 'amoxicillin' THEN 'contraindicated' ELSE 'severe' END AS severity FROM d WHERE n IN ('amoxicillin', 'aspirin')
 UNION ALL SELECT drug, 1, 'ingredient', 'Metformin', 'moderate' FROM d WHERE n = 'Glucophage' UNION ALL SELECT drug, 2, 'class', 'Amlodipine', 'mild' FROM d WHERE n = 'nifedipine'"""


@register("interaction_check", _CHECKED.format(drugs=DRUGS_ASKED_SQL))
def interaction_check(spark, sf_dir):
    return pipelines.interaction_check(*_drugs(spark, sf_dir), fx.SEVERITIES_OF.df(spark))


_LINKS = fx.Rows("id int, token string, is_active boolean, expires string, view_count int", (0, "a", True, "2024-02-01", 1), (1, "b", False, "2024-02-01", 1), (2, "c", True, "2024-01-01", None), (3, "d", None, "2024-02-01", 0), (4, "a", True, "2024-01-01", 2), (5, "a", None, "2024-03-01", 3))


@register("share_views", f"SELECT id, token, CASE WHEN token = 'a' AND coalesce(is_active, false) AND expires::TIMESTAMP > TIMESTAMP '2024-01-01' THEN coalesce(view_count, 0) + 1 ELSE view_count END AS view_count FROM {_LINKS.over_sql()}")
def share_views(spark, sf_dir):
    links = _LINKS.over(spark, sf_dir).withColumn("expires_at", F.col("expires").cast("timestamp_ntz"))
    return pipelines.share_views(links, "a", "2024-01-01").select("id", "token", "view_count")


@register("prompt_context", """WITH b AS (SELECT conv_id AS query_id, turn + 1 AS rank, '[Source ' || (turn + 1) || ': "' || role || '" — General]' || chr(10) || text AS block FROM conversations),
 c AS (SELECT *, sum(greatest(1, ceil(length(block) / 4))) OVER (PARTITION BY query_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM b)
 SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM c WHERE used <= 1000 OR place = 1 GROUP BY query_id""")
def prompt_context(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", F.col("conv_id").alias("query_id"), "turn", "role", "text")
    excerpts = c.select("query_id", (F.col("turn") + 1).alias("rank"), F.col("role").alias("title"), F.lit("General").alias("section"), F.col("text").alias("content"))
    turns = c.select("query_id", "turn", "role", F.col("text").alias("content"))
    profile = c.select("query_id").distinct().withColumn("profile", F.repeat(F.lit("word "), 6000))
    return pipelines.prompt(excerpts, turns, profile).select("query_id", "context")


@register("top_items_listed", "SELECT conv_id, array_to_string(list_slice(list_sort(list(role)), 1, 2), ', ') || CASE WHEN count(*) > 2 THEN ' and ' || (count(*) - 2) || ' more' ELSE '' END AS roles FROM conversations GROUP BY conv_id")
def top_items_listed(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("rs"))
    return c.select("conv_id", pipelines.listed(F.col("rs"), 2).alias("roles"))


@register("event_frames", """SELECT event_id, 'data: {"k":' || (props::JSON ->> '$.k') || '}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return scan(spark, sf_dir, "events", "event_id", "props").select("event_id", sinks.frame(F.struct(k.alias("k"))).alias("frame"))


@register("relative_days", "SELECT o_orderkey, CASE date_diff('day', o_orderdate::DATE, DATE '1996-06-30') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1996-06-30') < 7 THEN date_diff('day', o_orderdate::DATE, DATE '1996-06-30') || ' days ago' ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS label FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01'")
def relative_days(spark, sf_dir):
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", where=F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp_ntz"))
    return o.select("o_orderkey", pipelines.relative_day(F.col("o_orderdate"), F.lit("1996-06-30").cast("date")).alias("label"))


@register("entity_model_slices", "SELECT doc_id, sum(ceil(length(p) / 1200))::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p FROM documents) WHERE trim(p) <> '' GROUP BY doc_id")
def entity_model_slices(spark, sf_dir):
    d = scan(spark, sf_dir, "documents", "doc_id", F.explode(providers.slices(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"))


@register("second_readings", f"SELECT doc, page, confidence < 80 AS again FROM {fx.PAGES.over_sql()}")
def second_readings(spark, sf_dir):
    return fx.PAGES.over(spark, sf_dir).select("doc", "page", providers.needs_second_reading(F.col("confidence"), F.col("text")).alias("again"))


_REFINED = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN text || ' (checked)' WHEN 2 THEN left(text, length(text) // 2) ELSE left(text, length(text) - length(text) // 20) END"


@register("readings_merged", f"SELECT doc_id, sha256(CASE WHEN refined IS NULL OR length(refined) < 0.9 * length(text) THEN text ELSE refined END) AS sha FROM (SELECT doc_id, text, {_REFINED} AS refined FROM documents)")
def readings_merged(spark, sf_dir):
    """A second reading in place of the first where it lost no more than a tenth of it."""
    k, n = F.pmod("doc_id", F.lit(4)), F.length("text")
    refined = F.when(k == 1, F.concat("text", F.lit(" (checked)"))).when(k == 2, F.left("text", F.floor(n / 2).cast("int"))).when(k == 3, F.left("text", n - F.floor(n / 20).cast("int")))
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("refined", refined)
    return d.select("doc_id", F.sha2(providers.refined_reading(F.col("text"), F.col("refined")), 256).alias("sha"))


@register("lenient_json", f"SELECT doc, coalesce(json_valid(raw), false) OR coalesce(json_valid(nullif(regexp_extract(raw, '(\\{{.*\\}})', 1, 's'), '')), false) AS parsed FROM {fx.EXTRACTIONS.over_sql()}")
def lenient_json(spark, sf_dir):
    return fx.EXTRACTIONS.over(spark, sf_dir).select("doc", records.lenient_json(F.col("raw")).isNotNull().alias("parsed"))


@register("settings_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'en' END AS lang, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END AS nation FROM customer")
def settings_defaults(spark, sf_dir):
    c = scan(spark, sf_dir, "customer", "c_custkey", F.col("c_mktsegment").alias("lang"), F.col("c_nationkey").alias("nation"))
    return records.with_defaults(c.select("c_custkey"), c.where("c_custkey % 2 = 0"), "c_custkey", {"lang": "en", "nation": 0})


@register("share_revoke", f"SELECT id, token, CASE WHEN token = 'a' AND id % 2 = 0 THEN false ELSE is_active END AS is_active FROM {_LINKS.over_sql()}")
def share_revoke(spark, sf_dir):
    return records.revoked(_LINKS.over(spark, sf_dir).withColumn("owner", F.col("id") % 2), "a", "owner", 0).select("id", "token", "is_active")


@register("drop_repeated_last_turn", "SELECT conv_id, turn FROM conversations QUALIFY NOT (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND role = 'user' AND text = (SELECT max(text) FROM conversations WHERE role = 'user'))")
def drop_repeated_last_turn(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations")
    said = c.where("role = 'user'").agg(F.max("text")).scalar()
    return relational.without_repeated_last(c, "conv_id", "turn", "role", "text", said).select("conv_id", "turn")


@register("digest_priority", "SELECT user_id, CASE WHEN bool_or(value > 120) THEN 'urgent' WHEN bool_or(value > 60) THEN 'elevated' ELSE 'normal' END AS priority FROM events GROUP BY user_id")
def digest_priority(spark, sf_dir):
    level = F.when(F.col("value") > 120, "action_needed").when(F.col("value") > 60, "attention").otherwise("info")
    return safety.digest_priority(scan(spark, sf_dir, "events", "user_id", level.alias("level")), ["user_id"], "level")


@register("class_map_last_name", "SELECT p_brand, max_by(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def class_map_last_name(spark, sf_dir):
    return safety.class_map(scan(spark, sf_dir, "part", "p_brand", "p_name", "p_partkey"), "p_brand", "p_name", "p_partkey")


@register("answer_cache_key", r"SELECT conv_id, turn, sha256(conv_id::VARCHAR || ':' || role || ':' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM conversations")
def answer_cache_key(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", scalars.cache_key(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("key"))


@register("scanned_documents", "SELECT doc_id, length(trim(text)) < 50 AS scanned FROM documents")
def scanned_documents(spark, sf_dir):
    return scan(spark, sf_dir, "documents", "doc_id", is_scanned(F.col("text")).alias("scanned"))


_STATUSES = fx.Rows("id int, status string, cue string, evidence string, contradiction string", (0, "absent", "no", "No fever.", None), (1, "family", None, "Father had fever.", None), (2, "present", None, "Fever.", None), (3, "uncertain", "possible", "Possible fever.", None), (4, "uncertain", "no", "Fever seen.", "No fever."), (5, "historical", "", "x", None), (6, "hypothetical", "if", "", None), (7, None, None, None, None))


@register("status_explained", f"""WITH s AS (SELECT *, CASE WHEN cue <> '' THEN ' ("' || cue || '")' ELSE '' END AS because, CASE WHEN evidence <> '' THEN ' — "' || evidence || '"' ELSE '' END AS quote FROM {_STATUSES.over_sql()})
 SELECT id, CASE WHEN contradiction IS NOT NULL THEN '"fever" is written both ways in this document — "' || contradiction || '" but also "' || evidence || '". It has been kept in your record but not as a confirmed finding. Please check with your doctor which is correct.'
 WHEN status = 'absent' THEN '"fever" was left out of your record because the document says you do not have it' || because || quote || '.' WHEN status = 'family' THEN '"fever" was recorded as family history, not your own' || because || quote || '.'
 WHEN status = 'hypothetical' THEN '"fever" appears as advice about what to do if it happens, not as something you have' || because || quote || '.' WHEN status = 'historical' THEN '"fever" is recorded as past history rather than a current problem' || because || '.'
 WHEN status = 'uncertain' THEN '"fever" is written as a suspicion rather than a confirmed finding' || because || '.' END AS said FROM s""")
def status_explained(spark, sf_dir):
    s = _STATUSES.over(spark, sf_dir).select("id", F.struct("status", "cue", "evidence", "contradiction").alias("a"))
    return s.select("id", pipelines.status_note(F.lit("fever"), F.col("a")).alias("said"))
