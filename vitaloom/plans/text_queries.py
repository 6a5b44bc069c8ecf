"""Queries over retrieval, linking, text, safety, records, budgets and state, with their SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars
from vitaloom.operators import backends, budget, lexical, linking, records, retrieval, safety, text
from vitaloom.plans import catalogues as cat
from vitaloom.plans import fixtures as fx
from vitaloom.plans.catalogue import register
from vitaloom.sources.tables import combined_pages, scan, spread
from vitaloom.streaming import limits

# --- retrieval -------------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_STOPS = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
_TERMS = f"list_distinct(list_filter({_WORDS}, lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)))"
#: Searches ask every vector whose id is divisible by 20, and every item of the benchmark.
_DENSE_SQL = """dense0 AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 4) AS score
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
 dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense0 QUALIFY rank <= 20)"""
_LEXICAL_SQL = f"""q AS (SELECT item_id AS query_id, {_TERMS} AS terms FROM benchmark),
 t AS (SELECT query_id, unnest(terms) AS term FROM q), w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
 lexical0 AS (SELECT query_id, doc_id, count(*) * 0.1::DOUBLE AS score FROM w JOIN t USING (term) GROUP BY ALL),
 lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexical0 QUALIFY rank <= 20)"""


def _dense(spark, sf_dir):
    e = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_arm(e, q, "vec_id", "embedding", digits=4)


def _asked(spark, sf_dir):
    return scan(spark, sf_dir, "benchmark", F.col("item_id").alias("query_id"), scalars.content_terms(F.col("text")).alias("terms"))


def _lexical(spark, sf_dir):
    return retrieval.lexical_arm(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), _asked(spark, sf_dir), "doc_id", "text")


@register("dense_topk", f"WITH {_DENSE_SQL} SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


@register("lexical_topk", f"WITH {_LEXICAL_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lexical")
def lexical_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: Three owners, one of which has half of all rows; an owner's questions find its own rows only.
_OWNER = "CASE WHEN {0} % 4 < 2 THEN 0 ELSE {0} % 4 - 1 END"


@register("dense_topk_owned", f"""WITH e AS (SELECT *, {_OWNER.format("vec_id")} AS owner, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM e),
 s AS (SELECT q.vec_id AS query_id, e.owner, e.vec_id, round(list_dot_product(e.v, q.v) / (e.size * q.size), 4) AS score FROM n e JOIN n q ON q.owner = e.owner WHERE q.vec_id % 20 IN (0, 11))
 SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def dense_topk_owned(spark, sf_dir):
    e = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", F.expr(_OWNER.format("vec_id")).alias("owner"))
    q = e.where(F.pmod("vec_id", F.lit(20)).isin(0, 11)).select(F.col("vec_id").alias("query_id"), "owner", F.col("embedding").alias("q"))
    return retrieval.dense_arm(e, q, "vec_id", "embedding", digits=4, owner="owner")


@register("lexical_topk_owned", f"""WITH q AS (SELECT item_id AS query_id, {_OWNER.format("item_id")} AS owner, unnest({_TERMS}) AS term FROM benchmark), w AS (SELECT doc_id, {_OWNER.format("doc_id")} AS owner, unnest({_WORDS}) AS term FROM documents),
 s AS (SELECT query_id, doc_id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM w JOIN q USING (owner, term) GROUP BY ALL)
 SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def lexical_topk_owned(spark, sf_dir):
    docs = spread(scan(spark, sf_dir, "documents", "doc_id", "text", F.expr(_OWNER.format("doc_id")).alias("owner")))
    asked = _asked(spark, sf_dir).withColumn("owner", F.expr(_OWNER.format("query_id")))
    return retrieval.lexical_arm(docs, asked, "doc_id", "text", owner="owner").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _items(spark, sf_dir, *parts):
    """Questions made of the distinct words of every benchmark item, which are w1, w2 … in order."""
    words = F.array_distinct(retrieval.tokens(F.col("text")))
    items = scan(spark, sf_dir, "benchmark", F.col("item_id").alias("query_id"), words.alias("w")).where(F.size("w") >= 6)
    return items.select("query_id", F.concat(*[F.get("w", F.lit(p)) if isinstance(p, int) else F.lit(p) for p in parts]).alias("text"))


def _searched(spark, sf_dir, asked, **options):
    terms = lexical.parsed_queries(asked, "text", english=False).select(F.explode("terms").alias("term"))
    postings = lexical.index(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", english=False, only=terms)
    return retrieval.search_arm(postings, asked, "doc_id", english=False, **options)


_ITEMS_SQL = f"""i AS (SELECT item_id AS query_id, (SELECT list(x ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS k) GROUP BY x)) AS w FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(list_distinct(ws)) >= 6),
 p AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS spot FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))"""
_TOP_SQL = "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s QUALIFY rank <= 20"


@register("lexical_phrase", f"""WITH {_ITEMS_SQL}, n AS (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY spot) AS follows FROM p),
 h AS (SELECT query_id, doc_id FROM i JOIN n ON term = w[1] AND follows = w[2] UNION ALL SELECT query_id, doc_id FROM i JOIN p ON term = w[5]),
 s AS (SELECT query_id, doc_id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM h GROUP BY ALL) {_TOP_SQL}""")
def lexical_phrase(spark, sf_dir):
    """``"w1 w2" "w5"``: either is enough; an occurrence of the phrase or of the word is a cover of its own."""
    return _searched(spark, sf_dir, _items(spark, sf_dir, '"', 0, " ", 1, '" "', 4, '"'))


@register("lexical_minus", f"""WITH {_ITEMS_SQL}, e AS (SELECT query_id, doc_id, spot, term FROM i JOIN p ON term IN (w[1], w[2])), gone AS (SELECT DISTINCT query_id, doc_id FROM i JOIN p ON term = w[6]),
 c AS (SELECT query_id, doc_id, CASE WHEN lag(term) OVER x <> term THEN 0.1::DOUBLE / (spot - lag(spot) OVER x) END AS cover FROM e WINDOW x AS (PARTITION BY query_id, doc_id ORDER BY spot)),
 s AS (SELECT query_id, doc_id, round(sum(cover), 6) AS score FROM c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.query_id = c.query_id AND g.doc_id = c.doc_id) GROUP BY ALL HAVING sum(cover) IS NOT NULL) {_TOP_SQL}""")
def lexical_minus(spark, sf_dir):
    """``"w1" "w2" -"w6"``, all of which must hold: covers reach from one of the two words to the next of the other."""
    return _searched(spark, sf_dir, _items(spark, sf_dir, '"', 0, '" "', 1, '" -"', 5, '"'), any_term=False)


@register("lexical_topk_stems")
def lexical_topk_stems(spark, sf_dir):
    found = retrieval.lexical_arm(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), _asked(spark, sf_dir), "doc_id", "text", stems=True)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_FUSED_SQL = f"""{_DENSE_SQL}, {_LEXICAL_SQL},
 arms AS (SELECT query_id // 20 AS query_id, vec_id AS id, 1.0::DOUBLE / (60 + rank) AS p, score AS s, 'dense' AS arm FROM dense UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), NULL, 'lexical' FROM lexical),
 fused AS (SELECT query_id, id, sum(p) AS rrf, max(s) AS similarity, array_to_string(list_sort(list(DISTINCT arm)), '+') AS arms FROM arms GROUP BY ALL)"""


def _fused(spark, sf_dir):
    d = _dense(spark, sf_dir).select((F.col("query_id") / 20).cast("long").alias("query_id"), F.col("vec_id").alias("id"), "score", "rank")
    return retrieval.fused(d, _lexical(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")


@register("rrf_fuse", f"WITH {_FUSED_SQL} SELECT query_id, id, round(rrf, 9) AS rrf, similarity, arms FROM fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "id", F.round("rrf", 9).alias("rrf"), "similarity", "arms")


_FLOOR_SQL = "kept AS (SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM fused) WHERE similarity IS NULL OR (similarity >= 0.3 AND best - similarity <= 0.5))"


@register("similarity_floor", f"WITH {_FUSED_SQL}, {_FLOOR_SQL} SELECT query_id, id, similarity FROM kept")
def similarity_floor(spark, sf_dir):
    return retrieval.above_floors(_fused(spark, sf_dir), 0.3, 0.5).select("query_id", "id", "similarity")


_WEIGHT = "CASE WHEN regexp_matches(t, '[0-9]') THEN 2.0 WHEN length(t) >= 8 THEN 1.5 WHEN length(t) >= 5 THEN 1.2 ELSE 1.0 END"
_COVER_SQL = f"coalesce(list_sum([{_WEIGHT} FOR t IN terms IF len(list_filter(words, lambda w: w = t OR (length(t) >= 4 AND starts_with(w, t)))) > 0]) / nullif(list_sum([{_WEIGHT} FOR t IN terms]), 0), 0)::DOUBLE"


@register(
    "hybrid_search",
    f"""WITH {_FUSED_SQL}, {_FLOOR_SQL}, h AS (SELECT k.*, d.words, q2.terms, d.source FROM kept k LEFT JOIN (SELECT doc_id, source, {_TERMS} AS words FROM documents) d ON d.doc_id = k.id LEFT JOIN q q2 ON q2.query_id = k.query_id),
 s AS (SELECT query_id, id, arms, round(0.6 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.2 * {_COVER_SQL} + 0.12 * 0.5 + 0.08 * CASE WHEN source = 'src3' THEN 1 ELSE 0 END, 6) AS relevance FROM h)
 SELECT query_id, id, arms, relevance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) <= 6""",
)
def hybrid_search(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text", F.coalesce("source", F.lit("Unknown")).alias("section"))
    kept = retrieval.above_floors(_fused(spark, sf_dir), 0.3, 0.5)
    finds = retrieval.covered(kept, _asked(spark, sf_dir), docs, "id", "text", "section")
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    blended = retrieval.blend(finds.withColumn("day", F.lit(None).cast("timestamp_ntz")), day, "src3").withColumn("relevance", F.round("relevance", 6))
    return retrieval.ranked(blended, ["query_id"], "relevance", "id", 6).select("query_id", "id", "arms", "relevance")


@register("rerank_coverage", f"""WITH {_FUSED_SQL}, d AS (SELECT doc_id, {_TERMS} AS words FROM documents)
 SELECT f.query_id, f.id, round({_COVER_SQL}, 6) AS coverage FROM fused f JOIN q ON q.query_id = f.query_id JOIN d ON d.doc_id = f.id""")
def rerank_coverage(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text")
    finds = _fused(spark, sf_dir).select("query_id", "id").join(_asked(spark, sf_dir).select("query_id"), "query_id", "left_semi").join(docs.select("id"), "id", "left_semi")
    return retrieval.covered(finds, _asked(spark, sf_dir), docs, "id", "text").select("query_id", "id", F.round("coverage", 6).alias("coverage"))


_QUERIES = fx.Rows("id int, q string, added string", (0, "what is my sugar level", "glucose hba1c blood diabetes"), (1, "amlodipine", ""), (2, "my blood pressure", "bp systolic diastolic hypertension"), (3, "", ""), (4, None, None))


@register("query_expand", f"SELECT id, added FROM {_QUERIES.over_sql()}")
def query_expand(spark, sf_dir):
    return _QUERIES.over(spark, sf_dir).select("id", F.array_join(retrieval.expand(F.col("q"), cat.SYNONYMS), " ").alias("added"))


# --- linking ---------------------------------------------------------------------------------------------------

_TESTS = fx.Rows("id int, name string, key string", *[(k, *r) for k, r in enumerate([("Hb A1c", "hba1c"), ("Glycated Haemoglobin", "hba1c"), ("Serum Creatinine", "creatinine"), ("Potassium Hydroxide Prep", None), ("TLC", "wbc"), ("SGPT", "alt"), ("Serum Widgetase", None), ("Platelet Count Manual", "platelets"), ("", None), (None, None)])])


@register("analyte_link", f"SELECT id, name, key FROM {_TESTS.over_sql()}")
def analyte_link(spark, sf_dir):
    return linking.link_analytes(_TESTS.over(spark, sf_dir).drop("key"), cat.analytes(spark), "name").select("id", "name", "key")


_MEASURED = fx.Rows("id int, name string, v double, u string, factor double, unit string", *[(k, *r) for k, r in enumerate([("Creatinine", 88.4, "umol/L", 1 / 88.4, "mg/dL"), ("Platelets", 150000.0, "/cumm", 0.001, "10^9/L"), ("Fasting Blood Sugar", 5.5, "mmol/L", 18.0182, "mg/dL"), ("HbA1c", 7.2, None, 1.0, "%"), ("Creatinine x", 5.0, "furlongs", None, None), ("INR", 2.4, None, 1.0, None)])])


@register("analyte_convert", f"SELECT id, name, round((v + id % 5) * factor, 4) AS value, unit FROM {_MEASURED.over_sql()}")
def analyte_convert(spark, sf_dir):
    labs = _MEASURED.over(spark, sf_dir).select("id", "name", (F.col("v") + F.col("id") % 5).alias("v"), "u")
    out = linking.canonical_labs(labs, cat.analytes(spark), "name", "v", "u")
    return out.select("id", "name", F.round("canonical_value", 4).alias("value"), F.when(F.col("canonical_value").isNotNull(), F.col("canonical_unit")).alias("unit"))


_CONDITIONS = fx.Rows("id int, raw string, code string, matched_on string, confidence double", *[(k, *r) for k, r in enumerate([
    ("T2DM", "E11.9", "alias", 0.95), ("Type 2 Diabetes Mellitus", "E11.9", "exact", 1.0), ("DM type II", "E11.9", "alias", 0.95), ("Known case of uncontrolled Type II DM", "E11.9", "alias", 0.95), ("شوگر", "E11.9", "local-language", 0.85), ("shugaar", "E11.9", "local-language", 0.85),
    ("dama", "J45.909", "local-language", 0.85), ("pilia", "R17", "local-language", 0.85), ("severe left sided migraine headache with aura", None, "partial", 0.6), ("Ehlers-Danlos syndrome", None, None, None), ("jigar", None, None, None), ("", None, None, None), (None, None, None, None),
])])


@register("condition_link_cascade", f"SELECT id, raw, code, matched_on, confidence FROM {_CONDITIONS.over_sql()}")
def condition_link_cascade(spark, sf_dir):
    out = linking.link_conditions(_CONDITIONS.over(spark, sf_dir).select("id", "raw"), cat.conditions(spark), "raw", cat.lexicon(spark))
    return out.select("id", "raw", linking.suggested_code(F.col("confidence"), F.col("code")).alias("code"), "matched_on", F.col("confidence").cast("double").alias("confidence"))


_PHRASES = fx.Rows("id int, phrase string, english string", *[(k, *r) for k, r in enumerate([("khaansi", "cough"), ("khansee", "cough"), ("dama", "asthma"), ("pilia", "jaundice"), ("tibi", "tuberculosis"), ("dm", None), ("bp", None), ("blood pressure", "hypertension"), ("بخار", "fever"), ("دِمہ", "asthma"), ("الرجى", "allergy"), (None, None)])])


@register("local_term_lookup", f"SELECT id, phrase, english FROM {_PHRASES.over_sql()}")
def local_term_lookup(spark, sf_dir):
    return linking.local_terms(_PHRASES.over(spark, sf_dir).drop("english"), cat.lexicon(spark), "phrase").select("id", "phrase", "english")


_MISSPELT = fx.Rows("id int, raw string", *enumerate(["Metformn", "Amlodipin", "Zzyzx", "Aspirin", "Tab Metformn 500mg"]))
_CANDIDATES = fx.Rows("query string, rxcui string, name string, score double, rank int, source string", ("Metformn", "6809", "metformin", 9.1, 1, "RXNORM"), ("Metformn", "9999", "metolazone", 8.5, 2, "RXNORM"), ("Amlodipin", "17767", "Amlodipine Besylate", 8.2, 1, "OTHER"), ("Amlodipin", "17767", "amlodipine", 8.1, 2, "RXNORM"), ("Zzyzx", "1", "zyrtec", 8.9, 1, "RXNORM"), ("Aspirin", "1191", "aspirin", 5.0, 1, "RXNORM"))


@register(
    "drug_edit_match",
    f"""WITH c AS (SELECT *, levenshtein(lower(query), lower(name)) / greatest(length(query), length(name), 1) <= 0.34 AND score >= 8 AS ok FROM {_CANDIDATES.sql}),
 l AS (SELECT query, min_by(rxcui, rank) AS rxcui FROM c WHERE ok GROUP BY query), p AS (SELECT c.query, c.rxcui, min_by(name, (CASE WHEN source = 'RXNORM' THEN 0 ELSE 1 END, rank)) AS name FROM c JOIN l ON c.query = l.query AND c.rxcui = l.rxcui WHERE ok GROUP BY ALL)
 SELECT n.id, n.raw, coalesce(p.name, n.q) AS name, p.rxcui, coalesce(lower(p.name) <> lower(n.q), false) AS corrected FROM (SELECT id, raw, trim(regexp_replace(regexp_replace(raw, '(?i)\\btab\\b|\\d+mg', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM {_MISSPELT.over_sql()}) n LEFT JOIN p ON p.query = n.q""",
)
def drug_edit_match(spark, sf_dir):
    names = _MISSPELT.over(spark, sf_dir)
    return names.join(linking.drug_matches(names.select("raw").distinct(), _CANDIDATES.df(spark), "raw"), "raw").select("id", "raw", "name", "rxcui", "corrected")


# --- text ------------------------------------------------------------------------------------------------------


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p in fixed.SECTIONS) + " ELSE 'General' END"


@register("section_groups", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
 s AS (SELECT *, {_SECTION} AS sec FROM l),
 m AS (SELECT *, last_value(CASE WHEN sec <> 'General' THEN sec END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 g AS (SELECT *, sum(CASE WHEN i = 1 OR (sec <> 'General' AND sec IS DISTINCT FROM before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS grp FROM m)
 SELECT doc_id, grp::INTEGER AS "group", min_by(sec, i) AS section, length(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')) AS n_chars
 FROM g GROUP BY doc_id, grp HAVING bool_or(trim(line) <> '')""".replace("\\","\\"))
def section_groups(spark, sf_dir):
    return text.sections(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text").select("doc_id", "group", "section", F.length("body").alias("n_chars"))


@register("chunk_documents")
def chunk_documents(spark, sf_dir):
    c = text.chunks(spread(scan(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")), "doc_id", "text", "lang", "source")
    return c.select("doc_id", "chunk", "section", "tokens", F.sha2("content", 256).alias("content_sha256"))


_SENTENCES = fx.Rows("id int, text string, term string, status string, evidence string", *[(k, *r) for k, r in enumerate([
    ("No history of diabetes.", "diabetes", "absent", "No history of diabetes"), ("Tuberculosis was ruled out.", "tuberculosis", "absent", "Tuberculosis was ruled out"),
    ("No chest pain but complains of fever.", "chest pain", "absent", "No chest pain but complains of fever"), ("No chest pain but complains of fever.", "fever", "present", "No chest pain but complains of fever"),
    ("History of hepatitis B in 2015.", "hepatitis", "historical", "History of hepatitis B in 2015"), ("Father had a heart attack at 50.", "heart attack", "family", "Father had a heart attack at 50"),
    ("Mother reports the patient has asthma.", "asthma", "present", "Mother reports the patient has asthma"), ("Return to the clinic if you develop fever.", "fever", "hypothetical", "Return to the clinic if you develop fever"),
    ("Impression: possible tuberculosis.", "tuberculosis", "uncertain", "Impression: possible tuberculosis"), ("No history of diabetes. Advised annual diabetes screening.", "diabetes", "uncertain", "Advised annual diabetes screening"),
    ("Blood pressure 130/85.", "Type 2 diabetes mellitus", "present", ""), ("mujhe diabetes nahi hai", "diabetes", "absent", "mujhe diabetes nahi hai"),
    ("مریض کو شوگر نہیں ہے", "diabetes", "absent", "مریض کو شوگر نہیں ہے"), ("mujhe sugar nahi hai", "diabetes", "absent", "mujhe sugar nahi hai"), ("mujhe shugaar nahi hai", "diabetes", "absent", "mujhe shugaar nahi hai"),
    ("اگر بخار ہو تو آئیں", "fever", "hypothetical", "اگر بخار ہو تو آئیں"),
])])


@register("assertion_classify", f"SELECT id, status, evidence FROM {_SENTENCES.over_sql()}")
def assertion_classify(spark, sf_dir):
    """Every document says one of the sentences; the SQL states what each means."""
    said = _SENTENCES.over(spark, sf_dir).select("id", "text", "term")
    return text.assertions(said, "text", "term", cat.spellings()).select("id", "assertion.status", "assertion.evidence")


@register("own_findings_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE l_returnflag WHEN 'A' THEN 'present' WHEN 'R' THEN 'absent' ELSE 'uncertain' END IN ('present', 'historical', 'uncertain')")
def own_findings_filter(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "present").when(F.col("l_returnflag") == "R", "absent").otherwise("uncertain")
    return text.own_findings(scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", status.alias("status")), "status").drop("status")


#: A clinical line that a document carries before its own text.
_LINES = fx.Rows("doc_id int, line string", *enumerate([
    "Tab Augmentin-amoxicillin 625 mg BD, started in April", "Known type 2  Diabetes, hypertension and TB.", "HbA1c 7.4%, d-dimer raised; ALT,AST normal", "amlodipine given; Inj Ceftriaxone 1 g stat",
    "Amlodipine was stopped.\namlodipine 5mg od", "Hepatitis B and hepatitis; syrup once daily every 6 hours", "principal nostril pril", "vitamin D3 60000 IU weekly, insulin 10 units", "Metformin\r\nuse inhaler with prednisone, oral atorvastatin", "",
]))


def _clinical(spark, sf_dir):
    return _LINES.over(spark, sf_dir).join(spread(scan(spark, sf_dir, "documents", "doc_id", F.col("text").alias("own"))), "doc_id").select("doc_id", F.concat("line", F.lit("\n"), F.coalesce("own", F.lit(""))).alias("text"))


def _known_sql(known):
    """Phrases of marked text: every run of letters and digits stands between two marks, which takes the place of looking round."""
    word = lambda w: re.sub(r"[^\W_]+", lambda m: f"\x01{m[0]}\x02", w).replace(".", "\\.")
    return "|".join(r"\s+".join(map(word, k.split())) for k in sorted(known, key=len, reverse=True))


def _every(source, pattern, kind, score):
    return f"SELECT doc_id, '{kind}' AS type, {score}::DOUBLE AS score, unnest(m) AS text, generate_subscripts(m, 1) AS i, 0 AS l FROM (SELECT doc_id, regexp_extract_all({source}, '(?i){pattern}') AS m FROM d)"


_ENTITIES_SQL = rf"""d AS (SELECT doc_id, line || chr(10) || coalesce(own, '') AS text, regexp_replace(line || chr(10) || coalesce(own, ''), '([\p{{L}}\p{{N}}]+)', chr(1) || '\1' || chr(2), 'g') AS marked FROM (SELECT f.*, o.text AS own FROM {_LINES.over_sql()} JOIN documents o ON o.doc_id = f.doc_id)),
 w AS (SELECT doc_id, line, l, unnest(ws) AS text, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, line, l, regexp_extract_all(line, '\p{{L}}[\p{{L}}-]{{4,}}') AS ws FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS l FROM (SELECT doc_id, string_split_regex(text, '
?
') AS ls FROM d)))),
 g AS (SELECT doc_id, 'medication' AS type, CASE WHEN regexp_matches(line, '(?i){fixed.DOSE_EVIDENCE}') OR regexp_matches(line, '(?i){fixed.FREQUENCY_EVIDENCE}') OR regexp_matches(line, '(?i){fixed.FORM_EVIDENCE}') OR regexp_matches(line, '(?i){fixed.ROUTE_EVIDENCE}') THEN 0.75 ELSE 0.4 END::DOUBLE AS score, text, i, l
  FROM w WHERE regexp_matches(text, '(?i)(?:{fixed.DRUG_ENDINGS})$') AND lower(text) NOT IN ({", ".join(f"'{x}'" for x in fixed.NOT_DRUGS)})),
 a AS (SELECT *, 0 AS part FROM g UNION ALL SELECT *, 1 FROM ({_every("marked", _known_sql(fixed.KNOWN_CONDITIONS), "condition", 0.9)}) UNION ALL SELECT *, 2 FROM ({_every("marked", _known_sql(fixed.KNOWN_LAB_TESTS), "lab_test", 0.9)})
  UNION ALL SELECT *, 3 FROM ({_every("text", fixed.DOSAGES, "dosage", 1.0)}) UNION ALL SELECT *, 4 FROM ({_every("text", fixed.FREQUENCIES, "frequency", 1.0)})),
 c AS (SELECT doc_id, type, score, replace(replace(text, chr(1), ''), chr(2), '') AS text, (part, l, i) AS place FROM a)"""


@register("entity_rules_extract", f"WITH {_ENTITIES_SQL} SELECT doc_id, type, arg_min(text, (-score, place)) AS text, max(score) AS score FROM c GROUP BY doc_id, type, lower(text)")
def entity_rules_extract(spark, sf_dir):
    return text.rule_entities(_clinical(spark, sf_dir), "doc_id", "text").select("doc_id", "type", "text", "score")


@register("entity_backends", f"""WITH {_ENTITIES_SQL}, q AS (SELECT doc_id, p, n, unnest(range(0, length(p), 1200)) AS k FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\\n{{2,}}') AS ps FROM d))),
 m AS (SELECT doc_id, n, k, unnest(ws) AS text, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, n, k, list_filter(regexp_extract_all(substr(p, k + 1, 1200), '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{3,}}$')) AS ws FROM q)),
 k AS (SELECT doc_id, CASE length(text) % 4 WHEN 0 THEN 'condition' WHEN 1 THEN 'medication' WHEN 2 THEN 'lab_test' END AS type, least(1.0, length(text) / 12.0)::DOUBLE AS score, text, (9, n * 1000000 + k, i) AS place FROM m),
 b AS (SELECT *, 'rules' AS source FROM c UNION ALL SELECT doc_id, type, score, text, place, 'model' FROM k WHERE type IS NOT NULL AND score >= 0.45)
 SELECT doc_id, type, arg_min(text, (-score, place)) AS text, round(max(score), 6) AS score, arg_min(source, (-score, place)) AS source FROM b GROUP BY doc_id, type, lower(text)""")
def entity_backends(spark, sf_dir):
    """Rules beside a model's rows, each (type, text) as the surer of both says it."""
    return backends.entities(_clinical(spark, sf_dir), "doc_id", "text", "capitals").select("doc_id", "type", "text", F.round("score", 6).alias("score"), "source")


@register("embedded_passages", r"""WITH w AS (SELECT doc_id, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)),
 c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, 'passage:', 1 FROM w),
 h AS (SELECT doc_id, n, md5(w) AS h FROM c), s AS (SELECT doc_id, ('0x' || left(h, 4))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 5, 1))::BIGINT % 2 = 1 THEN n ELSE -n END)::DOUBLE AS x FROM h GROUP BY ALL)
 SELECT doc_id, slot::INTEGER AS slot, round((x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM s WHERE x <> 0""")
def embedded_passages(spark, sf_dir):
    e = backends.embedded(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), "text", "passage")
    return e.select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("doc_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


@register("entity_dedupe_best", f"SELECT doc, type, arg_min(text, (-score, place)) AS text, max(score) AS score FROM {fx.ENTITIES.over_sql()} GROUP BY doc, type, lower(text)")
def entity_dedupe_best(spark, sf_dir):
    return text.best_entities(fx.ENTITIES.over(spark, sf_dir), "doc").select("doc", "type", "text", "score")


@register("missed_entities_anti_join", f"""WITH e AS (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '(?i)\\d+(?:\\.\\d+)?\\s*mg', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM {fx.ENTITIES.over_sql()} WHERE score >= 0.6 AND type NOT IN ('dosage', 'frequency')),
 m AS (SELECT doc, type, lower(trim(regexp_replace(regexp_replace(name, '(?i)\\btab\\b|\\d+mg', ' ', 'g'), '\\s+', ' ', 'g'))) AS m FROM {fx.MENTIONED.over_sql()})
 SELECT doc, type, text, score FROM e WHERE length(n) >= 3 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc = e.doc AND m.type = e.type AND (contains(m.m, e.n) OR contains(e.n, m.m)))""")
def missed_entities_anti_join(spark, sf_dir):
    return safety.missed(fx.ENTITIES.over(spark, sf_dir), fx.MENTIONED.over(spark, sf_dir)).select("doc", "type", "text", "score")


# --- safety ----------------------------------------------------------------------------------------------------

_ASKED_DRUGS = fx.Rows("id int, name string, ingredient string, class string", (0, "amoxicillin", "amoxicillin", "Penicillins with extended spectrum"), (1, "Glucophage", "metformin", "Biguanides"), (2, "nifedipine", "nifedipine", "Dihydropyridine derivatives"), (3, "aspirin", "aspirin", "Salicylic acid and derivatives"))
#: Every document asks for one drug in a strength of its own.
DRUGS_ASKED_SQL = f"SELECT name || ' ' || id || 'mg' AS drug, [ingredient] AS ingredients, [class] AS classes FROM {_ASKED_DRUGS.over_sql()}"
_DRUGS_SQL = f"""drugs AS ({DRUGS_ASKED_SQL}),
 cur AS (SELECT * FROM (VALUES ('Metformin', ['metformin'], ['Biguanides']), ('Amlodipine', ['amlodipine'], ['Dihydropyridine derivatives'])) AS v(medication, ingredients, classes))"""


def _drugs(spark, sf_dir):
    asked = _ASKED_DRUGS.over(spark, sf_dir).select(F.concat("name", F.lit(" "), "id", F.lit("mg")).alias("drug"), F.array("ingredient").alias("ingredients"), F.array("class").alias("classes"))
    now = [("Metformin", ["metformin"], ["Biguanides"]), ("Amlodipine", ["amlodipine"], ["Dihydropyridine derivatives"])]
    return asked, spark.createDataFrame(now, "drug string, ingredients array<string>, classes array<string>")


_SINGULAR = "CASE WHEN length({0}) > 4 AND {0} LIKE '%s' THEN left({0}, length({0}) - 1) ELSE {0} END"


@register("allergy_match_join", f"""WITH {_DRUGS_SQL}, k AS (SELECT drug, unnest(string_split(lower(drug), ' ')) AS key FROM drugs UNION SELECT drug, lower(unnest(ingredients)) FROM drugs UNION SELECT drug, unnest(string_split(lower(array_to_string(classes, ' ')), ' ')) FROM drugs),
 a AS (SELECT allergen, severity, lower(allergen) AS key FROM {fx.SEVERITIES_OF.sql})
 SELECT DISTINCT k.drug, a.allergen, CASE WHEN lower(a.severity) = 'severe' THEN 'contraindicated' ELSE 'severe' END AS level, contains(lower(k.drug), {_SINGULAR.format('a.key')}) OR list_contains(d.ingredients, {_SINGULAR.format('a.key')}) AS same_substance
 FROM k JOIN a ON {_SINGULAR.format('k.key')} = {_SINGULAR.format('a.key')} JOIN drugs d ON d.drug = k.drug""")
def allergy_match_join(spark, sf_dir):
    return safety.allergy_findings(_drugs(spark, sf_dir)[0], fx.SEVERITIES_OF.df(spark))


@register("duplicate_ingredient_join", f"WITH {_DRUGS_SQL} SELECT drug, medication, array_to_string(list_sort(list_intersect(drugs.ingredients, cur.ingredients)), ', ') AS shared FROM drugs, cur WHERE len(list_intersect(drugs.ingredients, cur.ingredients)) > 0 AND lower(drug) <> lower(medication)")
def duplicate_ingredient_join(spark, sf_dir):
    return safety.shared_ingredients(*_drugs(spark, sf_dir))


@register("same_class_excl_join", f"WITH {_DRUGS_SQL} SELECT drug, medication, list_min(list_intersect(drugs.classes, cur.classes)) AS class FROM drugs, cur WHERE len(list_intersect(drugs.classes, cur.classes)) > 0 AND len(list_intersect(drugs.ingredients, cur.ingredients)) = 0")
def same_class_excl_join(spark, sf_dir):
    return safety.shared_classes(*_drugs(spark, sf_dir))


@register("max_severity", f"SELECT grp, list_extract(['info', 'mild', 'moderate', 'severe', 'contraindicated'], max(list_position(['info', 'mild', 'moderate', 'severe', 'contraindicated'], coalesce(severity, 'info')))) AS severity FROM {fx.SEVERITY.over_sql()} GROUP BY grp")
def max_severity(spark, sf_dir):
    return safety.highest_severity(fx.SEVERITY.over(spark, sf_dir), ["grp"], "severity")


# --- records ---------------------------------------------------------------------------------------------------


_JSON_EXPECTED = fx.Rows(
    "doc long, first_name string, first_active boolean, first_number double, hospital string, language string, n_medications int, n_diagnoses int, empty boolean",
    (1, "Metformin", True, 7200.0, None, "en", 2, 0, False), (2, None, None, None, None, None, 0, 1, False), *[(d, None, None, None, None, None, 0, 0, True) for d in (3, 4, 5, 6)],
)


@register("json_coerce", f"SELECT doc, first_name, first_active, first_number, hospital, language, n_medications, n_diagnoses FROM {_JSON_EXPECTED.over_sql()}")
def json_coerce(spark, sf_dir):
    e = fx.EXTRACTIONS.over(spark, sf_dir).withColumn("e", records.extraction(F.col("raw")))
    return e.select("doc", F.get("e.medications", F.lit(0))["name"].alias("first_name"), F.get("e.medications", F.lit(0))["isActive"].alias("first_active"), F.get("e.labResults", F.lit(0))["numericValue"].alias("first_number"), "e.hospital", "e.language", F.size("e.medications").alias("n_medications"), F.size("e.diagnoses").alias("n_diagnoses"))


@register("extraction_explode", f"SELECT t.doc_id AS doc, name, active FROM documents t JOIN (VALUES ('Metformin', true), (NULL, false)) AS v(name, active) ON t.doc_id % {fx.EXTRACTIONS.keys()} = 0")
def extraction_explode(spark, sf_dir):
    e = fx.EXTRACTIONS.over(spark, sf_dir).withColumn("e", records.extraction(F.col("raw")))
    return records.entity_rows(e, "e", "medications", "doc").select("doc", "name", F.col("isActive").alias("active"))


@register("extraction_empty_flag", f"SELECT doc, empty FROM {_JSON_EXPECTED.over_sql()}")
def extraction_empty_flag(spark, sf_dir):
    return fx.EXTRACTIONS.over(spark, sf_dir).select("doc", records.is_empty(records.extraction(F.col("raw"))).alias("empty"))


@register("review_status", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'failed' WHEN l_returnflag = 'A' AND l_linenumber = 6 THEN 'pending' WHEN l_quantity < 45 OR l_linestatus = 'O' THEN 'needs_review' ELSE 'confirmed' END AS status FROM lineitem")
def review_status(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    failed = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), "permanent").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 6), "transient")
    return li.select("l_orderkey", "l_linenumber", records.review_status(F.lit(False), failed, F.col("l_quantity"), F.col("l_linestatus") == "O").alias("status"))


@register("upsert_do_nothing", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_do_nothing(spark, sf_dir):
    held = scan(spark, sf_dir, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.insert_new(held, scan(spark, sf_dir, "customer", F.col("c_custkey").alias("id"), F.upper("c_name").alias("name")), "id")


@register("replace_document_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, 99, sum(l_quantity) FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey")
def replace_document_rows(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    fresh = li.where("l_orderkey % 10 = 0").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity")).select("l_orderkey", F.lit(99).alias("l_linenumber"), "l_quantity")
    return records.replaced(li, fresh, "l_orderkey")


@register("patch_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def patch_fields(spark, sf_dir):
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return records.patched(o, o.where("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(None).cast("double")}), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@register("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = scan(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), where=F.col("o_orderstatus") == "F")
    return records.cascade(scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), gone, "l_orderkey")


@register("cascade_set_null", "SELECT l_linenumber, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN NULL ELSE l_orderkey END AS l_orderkey FROM lineitem")
def cascade_set_null(spark, sf_dir):
    gone = scan(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), where=F.col("o_orderstatus") == "F")
    return records.cascade(scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), gone, "l_orderkey", set_null=True)


@register("ocr_page_combine", f"""SELECT doc, coalesce(string_agg('-- page ' || page || ' of ' || n || ' --' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page) FILTER (WHERE trim(text) <> ''), '') AS text, coalesce(floor(avg(confidence) FILTER (WHERE trim(text) <> '') + 0.5)::INTEGER, 0) AS confidence,
 count(*) FILTER (WHERE handwritten) > count(*) / 2 AS handwritten FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM {fx.PAGES.over_sql()}) GROUP BY doc""")
def ocr_page_combine(spark, sf_dir):
    return combined_pages(fx.PAGES.over(spark, sf_dir), "doc")


# --- budgets and state -----------------------------------------------------------------------------------------

_COST = "greatest(1, ceil(length(text) / 4))::BIGINT"


@register("prompt_budget_prefix", f"""WITH c AS (SELECT conv_id, turn, {_COST} AS cost FROM conversations), r AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, used::BIGINT AS used, place::INTEGER AS place FROM r WHERE used <= 120 OR place = 1""")
def prompt_budget_prefix(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long").alias("cost"))
    return budget.prefix(c, ["conv_id"], [F.col("turn")], "cost", 120).select("conv_id", "turn", "used", "place")


@register("history_budget_suffix", f"WITH c AS (SELECT conv_id, turn, {_COST} AS cost FROM conversations) SELECT conv_id, turn FROM c QUALIFY sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 200")
def history_budget_suffix(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long").alias("cost"))
    return budget.suffix(c, ["conv_id"], [F.desc("turn")], "cost", 200).select("conv_id", "turn")


@register("digest_line_budget", """WITH l AS (SELECT doc_id, ceil(length(text) / 4) > 100 AS cut, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 r AS (SELECT *, sum(greatest(1, ceil(length(line) / 4))) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l)
 SELECT doc_id, any_value(cut) AS cut, CASE WHEN any_value(cut) THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= 100), '') || chr(10) || chr(10) || '(Older entries omitted to stay within the review limit.)' ELSE any_value(text) END AS text FROM r GROUP BY doc_id""")
def digest_line_budget(spark, sf_dir):
    return budget.lines(spread(scan(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", 100, scalars.token_estimate)


@register(
    "rate_limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT user_id, event_id, t, i, true AS accepted, NULL::BIGINT AS wait, 1::BIGINT AS n, t + 172800000000 AS reset FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, f.reset <= e.t OR f.n < 3, CASE WHEN f.reset > e.t AND f.n >= 3 THEN greatest(1, ceil((f.reset - e.t) / 1000000.0))::BIGINT END, CASE WHEN f.reset <= e.t THEN 1 WHEN f.n >= 3 THEN f.n ELSE f.n + 1 END, CASE WHEN f.reset <= e.t THEN e.t + 172800000000 ELSE f.reset END
 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, t, event_id AS id, accepted, wait AS retry_after FROM f""",
)
def rate_limit_fixed_window(spark, sf_dir):
    return limits.limited(scan(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3, 172800)


@register("stalled_sweep", """SELECT event_id, CASE WHEN p AND late THEN 'failed' WHEN p THEN 'processing' ELSE event_type END AS status FROM (SELECT *, event_type = 'click' AS p, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTES AS late FROM events)""")
def stalled_sweep(spark, sf_dir):
    e = scan(spark, sf_dir, "events", "event_id", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"), F.when(F.col("user_id") % 3 != 0, F.col("ts")).alias("started_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("updated_at"), F.lit(None).cast("string").alias("note"))
    return limits.swept(e, "2024-01-15").select("event_id", "status")


_SCOPE = "CASE event_type WHEN 'click' THEN 'chat' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'upload' ELSE 'search' END"


@register("rate_limits_table", f"SELECT event_id, scope, requests, seconds FROM (SELECT event_id, {_SCOPE} AS scope FROM events) JOIN (VALUES " + ", ".join(f"('{s}', {n}, {w})" for s, n, w in fixed.RATE_LIMITS) + ") AS v(scope, requests, seconds) USING (scope)")
def rate_limits_table(spark, sf_dir):
    """What each event is limited to by its scope."""
    table = spark.createDataFrame(list(fixed.RATE_LIMITS), "scope string, requests int, seconds int")
    return scan(spark, sf_dir, "events", "event_id", F.expr(_SCOPE).alias("scope")).join(table, "scope").select("event_id", "scope", "requests", "seconds")
