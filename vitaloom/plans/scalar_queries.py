"""Queries over scalar functions, on inline rows and on documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars
from vitaloom.plans import fixtures as fx
from vitaloom.plans.catalogue import register
from vitaloom.sources.tables import KINDS, kind_of_mime, scan, spread

_DIGITS = f"translate(raw, '{fixed.EASTERN_DIGITS[0]}', '{fixed.EASTERN_DIGITS[1]}')"
_COMMAS = r"regexp_replace(regexp_replace({}, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"


@register("digits_normalize", f"SELECT id, {_DIGITS} AS digits FROM {fx.VALUES.over_sql()}")
def digits_normalize(spark, sf_dir):
    return fx.VALUES.over(spark, sf_dir).select("id", scalars.ascii_digits(F.col("raw")).alias("digits"))


@register(
    "medical_value_parse",
    rf"""WITH s AS (SELECT id, trim({_COMMAS.format(_DIGITS)}) AS s FROM {fx.VALUES.over_sql()}),
 p AS (SELECT id, regexp_extract(s, '^[^\d+-]*([+-]?\d+(?:\.\d+)?)', 1) AS n, regexp_extract(s, '^(<=|>=|≤|≥|<|>)', 1) AS c FROM s)
 SELECT id, try_cast(nullif(n, '') AS DOUBLE) AS value, CASE WHEN n <> '' THEN CASE c WHEN '<=' THEN '≤' WHEN '>=' THEN '≥' WHEN '' THEN NULL ELSE c END END AS censoring FROM p""",
)
def medical_value_parse(spark, sf_dir):
    return fx.VALUES.over(spark, sf_dir).withColumn("p", scalars.measured_value(F.col("raw"))).select("id", F.col("p.value").alias("value"), F.col("p.censoring").alias("censoring"))


_N = r"(-?\d+(?:\.\d+)?)"
_WORDS = "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in fixed.QUALITATIVE_RANGES.items()) + " END"


def _range_sql(source: str, keep: str) -> str:
    two = [rf"(?i){_N}\s*(?:to|[-–—])\s*{_N}", rf"{_N}\s*/\s*{_N}"]
    up, down = rf"(?i)(?:<=?|≤|up\s*to|less\s+than|below|max(?:imum)?)\s*{_N}", rf"(?i)(?:>=?|≥|at\s*least|greater\s+than|more\s+than|above|min(?:imum)?)\s*{_N}"
    num = lambda p, g: f"try_cast(nullif(regexp_extract(t, '{p}', {g}), '') AS DOUBLE)"
    pick = f"CASE WHEN q IS NOT NULL THEN 0 WHEN regexp_matches(t, '{two[0]}') THEN 1 WHEN regexp_matches(t, '{two[1]}') THEN 2 WHEN regexp_matches(t, '{up}') THEN 3 WHEN regexp_matches(t, '{down}') THEN 4 END"
    return rf"""(WITH s AS (SELECT {keep}, trim({_DIGITS}) AS s FROM {source}), w AS (SELECT *, regexp_replace(lower(s), '[.\s]+$', '') AS w, {_COMMAS.format("s")} AS t FROM s),
 q AS (SELECT *, {_WORDS} AS q FROM w), k AS (SELECT *, {pick} AS k FROM q)
 SELECT {keep}, CASE k WHEN 1 THEN least({num(two[0], 1)}, {num(two[0], 2)}) WHEN 2 THEN least({num(two[1], 1)}, {num(two[1], 2)}) WHEN 4 THEN {num(down, 1)} END AS low,
 CASE k WHEN 1 THEN greatest({num(two[0], 1)}, {num(two[0], 2)}) WHEN 2 THEN greatest({num(two[1], 1)}, {num(two[1], 2)}) WHEN 3 THEN {num(up, 1)} END AS high, q AS qualitative FROM k)"""


@register("reference_range_parse", f"SELECT id, low, high, qualitative FROM {_range_sql(fx.RANGES.over_sql(), 'id')}")
def reference_range_parse(spark, sf_dir):
    r = fx.RANGES.over(spark, sf_dir).withColumn("r", scalars.reference_range(F.col("raw")))
    return r.select("id", F.col("r.min").alias("low"), F.col("r.max").alias("high"), F.col("r.qualitative").alias("qualitative"))


@register("out_of_range_flag", f"SELECT id, CASE WHEN value IS NOT NULL AND (low IS NOT NULL OR high IS NOT NULL) THEN coalesce(value < low, false) OR coalesce(value > high, false) END AS out FROM {_range_sql(fx.FLAGS.over_sql(), 'id, value')}")
def out_of_range_flag(spark, sf_dir):
    return fx.FLAGS.over(spark, sf_dir).select("id", scalars.out_of_range(F.col("value"), scalars.reference_range(F.col("raw"))).alias("out"))


_UNIT = r"regexp_replace(regexp_replace(replace(replace(lower({}), 'µ', 'u'), 'μ', 'u'), '\s+', '', 'g'), '^per', '/')"


@register("unit_convert", f"""SELECT id, round(CASE WHEN canonical IS NULL OR unit IS NULL OR trim(unit) = '' THEN value WHEN factor IS NOT NULL AND {_UNIT.format('unit')} = 'umol/l' THEN value * factor
 WHEN factor IS NOT NULL AND {_UNIT.format('unit')} = 'mmol/l' THEN value * factor WHEN {_UNIT.format('unit')} = {_UNIT.format('canonical')} THEN value END, 6) AS value FROM {fx.UNITS.over_sql()}""")
def unit_convert(spark, sf_dir):
    factors = F.when(F.col("factor").isNotNull(), F.create_map(F.lower("unit"), "factor")).otherwise(F.create_map().cast("map<string,double>"))
    return fx.UNITS.over(spark, sf_dir).select("id", F.round(scalars.converted(F.col("value"), F.col("unit"), F.col("canonical"), factors), 6).alias("value"))


@register("test_name_normalize", rf"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\(.*?\)', ' ', 'g'), '[^\p{{L}}\p{{N}}%^/]+', ' ', 'g'), '\b(?:serum|plasma|blood|s|p|test|level|levels|conc|concentration)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM {fx.NAMES.over_sql()}""")
def test_name_normalize(spark, sf_dir):
    return fx.NAMES.over(spark, sf_dir).select("id", scalars.test_name(F.col("raw")).alias("name"))


test_name_normalize.__test__ = False

_URDU = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


@register("script_detect", f"""WITH c AS (SELECT id, length(raw) - length(regexp_replace(raw, '{_URDU}', '', 'g')) AS u, length(raw) - length(regexp_replace(raw, '[A-Za-z]', '', 'g')) AS l FROM {fx.SCRIPTS.over_sql()})
 SELECT id, CASE WHEN u + l = 0 THEN 'unknown' WHEN u / (u + l) >= 0.85 THEN 'urdu' WHEN u / (u + l) <= 0.15 THEN 'latin' ELSE 'mixed' END AS script FROM c""")
def script_detect(spark, sf_dir):
    return fx.SCRIPTS.over(spark, sf_dir).select("id", scalars.script(F.col("raw")).alias("script"))


def _squeezed(e: str) -> str:
    """RE2 has no back references: each letter on its own."""
    for c in "abcdefghijklmnopqrstuvwxyz":
        e = f"regexp_replace({e}, '{c}+', '{c}', 'g')"
    return e


_FOLDED = "regexp_replace(lower(raw), '[^a-z]', '', 'g')"
for _a, _b in fixed.DIGRAPHS:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"


@register("roman_key", f"WITH a AS (SELECT id, {_squeezed(_FOLDED)} AS s FROM {fx.ROMAN.over_sql()}), b AS (SELECT id, left(s, 1) || regexp_replace(substr(s, 2), '[aeiou]', '', 'g') AS s FROM a) SELECT id, {_squeezed('s')} AS key FROM b")
def roman_key(spark, sf_dir):
    return fx.ROMAN.over(spark, sf_dir).select("id", scalars.sound_key(F.col("raw")).alias("key"))


_DRUG = r"regexp_replace(raw, '(?i)\[unclear:[^\]]*\]', ' ', 'g')"
for _p in (fixed.DRUG_FORMS, fixed.DRUG_STRENGTHS, fixed.DRUG_TIMES):
    _DRUG = f"regexp_replace({_DRUG}, '(?i){_p}', ' ', 'g')"


@register("drug_noise_strip", rf"SELECT id, trim(regexp_replace(regexp_replace({_DRUG}, '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM {fx.DRUGS.over_sql()}")
def drug_noise_strip(spark, sf_dir):
    return fx.DRUGS.over(spark, sf_dir).select("id", scalars.drug_name(F.col("raw")).alias("name"))


@register("token_estimate", r"""SELECT doc_id, greatest(1, ceil((length(text) - length(regexp_replace(text, '[\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}]', '', 'g'))) / 2.5
 + (length(regexp_replace(text, '[\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}]', '', 'g')) + length(text) - length(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '', 'g'))) / 4))::INTEGER AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    return scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens"))


@register("recency_score", "SELECT o_orderkey, round(CASE WHEN o_orderdate IS NULL THEN 0.5 WHEN o_orderdate > TIMESTAMP '1996-06-30' THEN 1.0 ELSE greatest(0.0, 1 - epoch(TIMESTAMP '1996-06-30' - o_orderdate) / 86400.0 / 1095) END, 6)::DOUBLE AS recency FROM orders")
def recency_score(spark, sf_dir):
    day = F.lit("1996-06-30").cast("timestamp_ntz")
    return scan(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.round(scalars.recency(F.col("o_orderdate"), day), 6).alias("recency"))


@register("term_weights", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)
 SELECT term, CASE WHEN regexp_matches(term, '[0-9]') THEN 2.0 WHEN length(term) >= 8 THEN 1.5 WHEN length(term) >= 5 THEN 1.2 ELSE 1.0 END::DOUBLE AS weight FROM t""")
def term_weights(spark, sf_dir):
    words = scan(spark, sf_dir, "benchmark", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("term")).distinct()
    return words.select("term", scalars.term_weight(F.col("term")).alias("weight"))


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p in fixed.SECTIONS) + " ELSE 'General' END"


@register("section_detect", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, {_SECTION} AS section, count(*) AS n FROM l GROUP BY ALL")
def section_detect(spark, sf_dir):
    lines = spread(scan(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", scalars.section_of(F.col("line")).alias("section")).agg(F.count("*").alias("n"))


@register("model_failure_classify", rf"""WITH p AS (SELECT *, regexp_extract(message, '(?i)try again in\s+(?:(\d+)m)?([\d.]+)s', 1) AS m, regexp_extract(message, '(?i)try again in\s+(?:(\d+)m)?([\d.]+)s', 2) AS s FROM {fx.FAILURES.over_sql()})
 SELECT id, CASE WHEN coalesce(status = 429, false) OR regexp_matches(message, '(?i)rate.?limit|quota|too many requests') THEN 'rate_limit'
 WHEN coalesce(status >= 500, false) OR coalesce(code IN ('ECONNRESET', 'ETIMEDOUT'), false) OR regexp_matches(message, '(?i)timeout|aborted|fetch failed|network|socket hang up|ECONNREFUSED') THEN 'transient' ELSE 'permanent' END AS kind,
 coalesce(CASE WHEN try_cast(header AS DOUBLE) >= 0 THEN try_cast(header AS DOUBLE) END, CASE WHEN s <> '' THEN ceil(coalesce(try_cast(nullif(m, '') AS DOUBLE), 0) * 60 + s::DOUBLE) END) AS wait FROM p""")
def model_failure_classify(spark, sf_dir):
    f = fx.FAILURES.over(spark, sf_dir)
    return f.select("id", scalars.failure_kind(F.col("status"), F.col("code"), F.col("message")).alias("kind"), scalars.retry_seconds(F.col("header"), F.col("message")).alias("wait"))


@register("props_number", """SELECT event_id, (props::JSON ->> '$.k')::DOUBLE AS k FROM events""")
def props_number(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return scan(spark, sf_dir, "events", "event_id", "props").select("event_id", scalars.optional_number(v).alias("k"))


@register("file_name_clean", r"SELECT page_id, right(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), 120) AS name FROM pages")
def file_name_clean(spark, sf_dir):
    return scan(spark, sf_dir, "pages", "page_id", F.right(F.regexp_replace("url", "[^a-zA-Z0-9._-]", "_"), F.lit(120)).alias("name"))


_TYPES = fx.Rows("id int, mime string", *enumerate(["Text/Plain; charset=utf-8", "application/pdf", "video/mp4", "image/HEIC", " text/csv ", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None, ""]))
_KINDS = fx.Rows("mime string, kind string", *KINDS.items())


@register("mime_kinds", f"SELECT f.id, k.kind FROM {_TYPES.over_sql()} LEFT JOIN {_KINDS.sql.replace('AS f(', 'AS k(')} ON k.mime = lower(trim(split_part(f.mime, ';', 1)))")
def mime_kinds(spark, sf_dir):
    return _TYPES.over(spark, sf_dir).select("id", kind_of_mime(F.col("mime")).alias("kind"))


@register("standalone_question", r"""SELECT conv_id, turn, length(trim(text)) > 140 OR NOT (regexp_matches(text, '(?i)\b(?:it|its|that|this|those|these|they|them|their|there|then|he|she|his|her|same|above|earlier|before)\b')
 OR regexp_matches(text, '(?i)^\s*(?:and|but|so|also|what about|how about|why|ok|okay|then)\b')) AS standalone FROM conversations WHERE role = 'user'""")
def standalone_question(spark, sf_dir):
    refers = F.rlike("text", F.lit(r"(?i)(?<![A-Za-z0-9_])(?:it|its|that|this|those|these|they|them|their|there|then|he|she|his|her|same|above|earlier|before)(?![A-Za-z0-9_])"))
    goes_on = F.rlike("text", F.lit(r"(?i)^\s*(?:and|but|so|also|what about|how about|why|ok|okay|then)(?![A-Za-z0-9_])"))
    turns = scan(spark, sf_dir, "conversations", "conv_id", "turn", "text", where=F.col("role") == "user")
    return turns.select("conv_id", "turn", ((F.length(F.trim("text")) > 140) | ~(refers | goes_on)).alias("standalone"))
