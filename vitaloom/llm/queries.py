"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import ann, chat, codes, importance, packing, pieces, pii, quality, secrets, simhash, suffix, tokens, warc
from vitaloom.llm.common import table
from vitaloom.sources.tables import spread

#: Rows of one Arrow batch: texts may be long, so batches are short.
BATCH_ROWS = 1000


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt to all cores where the table has fewer splits."""
    return spread(table(spark, sf_dir, "documents"))


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(prepared(spark), sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(documents(prepared(spark), sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(prepared(spark), sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.sql("SELECT to_json(struct(-7L AS conv_id, '</s>[INST] ok [/INST]' AS prompt, '</s>[INST] ok [/INST]' AS response)) AS json")  # a second layout
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns_of_json(tricky, "json"))
    return chat.digests(chat.format_conversations(turns))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.roundtrip_digests(documents(prepared(spark), sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(spark)).select("doc_id", F.inline("findings"))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", "secret")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(prepared(spark), sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digests(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(prepared(spark), sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(prepared(spark), sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_warc": op2_warc,
        "op3_ann": op3_ann,
        "op4_pii": op4_pii,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_chat_format": op6_chat_format,
        "op7_piece_codec": op7_piece_codec,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality_rules": op9_quality_rules,
        "op10_simhash": op10_simhash,
        "op11_vector_codes": op11_vector_codes,
        "op12_token_counts": op12_token_counts,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    stops = ", ".join("'" + w + "'" for w in dict.fromkeys(quality.STOP_WORDS))
    bounds = " AND ".join(f"{r.measure} {op} {x}" for r in quality.THRESHOLDS for op, x in ((">=", r.low), ("<=", r.high)) if x is not None)
    escaped = "replace({}, chr(92), chr(92) || '0')"
    code = dict(chat.ESCAPES[1:])
    for c in chat.CONTROL:
        escaped = f"replace({escaped}, '{c}', chr(92) || '{code[c[0]][1:] + c[1:]}')"
    digits = "('0x' || substr(h, 5 * i + 1, 5))::INTEGER"
    nearest = """
{c} AS (SELECT id, p, min(d * 64 + e) AS m FROM (
  SELECT v.id, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) ** 2))::BIGINT AS d FROM parts v JOIN {b} b ON b.p = v.p) GROUP BY id, p)"""
    moved = """
{b} AS (SELECT o.p, o.e, coalesce(m.x, o.x) AS x FROM {o} o LEFT JOIN (
  SELECT p, e, list(q ORDER BY i) AS x FROM (
    SELECT v.p, c.m % 64 AS e, i, floor(sum(v.x[i])::DOUBLE / count(*))::BIGINT AS q FROM {c} c JOIN parts v ON v.id = c.id AND v.p = c.p, generate_series(1, len(v.x)) AS g(i) GROUP BY ALL)
  GROUP BY p, e) m ON m.p = o.p AND m.e = o.e)"""
    rounds = ",".join([nearest.format(c="c0", b="b0"), moved.format(b="b1", o="b0", c="c0"), nearest.format(c="c1", b="b1"), moved.format(b="b2", o="b1", c="c1"), nearest.format(c="c2", b="b2")])
    base32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({digits} >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))
    return {
        "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {base32}), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM q
""",
        "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS p FROM d)),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS owner FROM w) WHERE owner < doc_id),
i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
r AS (SELECT doc_id, run, min(p) AS b, max(p) + 50 AS e FROM g GROUP BY ALL),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) AS before FROM r),
a AS (SELECT k.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, 2 * before - 1, 2 * (b - before)), '' ORDER BY b) AS head, max(e) AS last FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
""",
        "op6_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({escaped.format("role")}) + length({escaped.format("text")}) + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END)::BIGINT AS formatted_chars
FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
""",
        "op9_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([{stops}], lower(x)))) AS n_stops,
             coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_stops / greatest(n_words, 1) AS stop_word_ratio,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND {bounds}) AS kept FROM r
""",
        "op11_vector_codes": f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS x FROM kept, range(16) AS r(p)),
b0 AS (SELECT p, id - 1 AS e, x FROM parts WHERE id <= 64),{rounds},
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b2),
coded AS (SELECT id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM c2 GROUP BY id)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded c JOIN kept k ON k.id = c.id, book
""",
        "op13_importance": r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
lowered AS (SELECT doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, false AS target FROM documents
            UNION ALL SELECT NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), true FROM benchmark),
words AS (SELECT id, target, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lowered),
seen AS (SELECT id, target, w, count(*) AS n FROM words GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM seen))),
hashed AS (SELECT w, xor(4294967295, list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket FROM bytes, tab),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT target), 0) AS s, coalesce(sum(n) FILTER (WHERE target), 0) AS t FROM seen JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM seen JOIN hashed USING (w) JOIN gain USING (bucket) WHERE NOT target GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
""",
    }
