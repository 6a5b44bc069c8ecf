"""Expectations on small inline rows."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vitaloom.functions import scalars
from vitaloom.operators import budget, linking, pipelines, providers, records, relational, retrieval, safety, text, trends
from vitaloom.plans import catalogues
from vitaloom.sources import tables
from vitaloom.streaming import limits


def series(spark, values, days=30):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", start + dt.timedelta(days=days * k), v) for k, v in enumerate(values)], "k string, ts timestamp_ntz, v double")


@pytest.mark.parametrize(
    ("values", "days", "want"),
    [([100.0] * 4, 30, "stable"), ([100.0, 125.0, 150.0, 175.0, 200.0], 7, "rising"), ([300.0, 250.0, 200.0, 150.0, 100.0], 7, "falling"), ([150.0], 30, "stable"), ([0.0, 0.0], 30, "stable")],
)
def test_direction(spark, values, days, want):
    s = trends.statistics(series(spark, values, days), ["k"], "ts", "v")
    assert s.select(trends.direction(F.col("slope"), F.col("sd"), F.col("mean"))).first()[0] == want


def test_sample_deviation_and_anomaly(spark):
    row = trends.statistics(series(spark, [80.0, 90.0, 100.0, 110.0, 120.0]), ["k"], "ts", "v").first()
    assert round(row.sd, 2) == 15.81 and row.n == 5
    odd = series(spark, [100.0, 102.0, 98.0, 101.0, 99.0, 200.0]).withColumn("id", F.lit(1))
    assert [(r["index"], r["v"]) for r in trends.anomalies(odd, ["k"], "ts", "v", "id").collect()] == [(5, 200.0)]
    assert trends.anomalies(series(spark, [5.0] * 3).withColumn("id", F.lit(1)), ["k"], "ts", "v", "id").count() == 0


def test_series_without_values(spark):
    assert trends.statistics(series(spark, [None, None]), ["k"], "ts", "v").count() == 0


def test_range_of_newest_row(spark):
    rows = [("s", dt.datetime(2024, 1, k), v, r) for k, v, r in [(1, 110.0, "1-2"), (2, 120.0, "70-100"), (3, 130.0, ""), (4, 60.0, None)]]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, r string")
    got = trends.against_range(df, ["k"], "ts", "v", "r").first()
    assert (got.range_min, got.range_max, got.above, got.below, got.within) == (70.0, 100.0, 3, 1, False)


def test_scopes(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "owner int, id string")
    mine = relational.scoped(df, "owner", 1)
    assert relational.in_scope(mine, "id", None).count() == 2
    assert relational.in_scope(mine, "id", []).count() == 0
    assert relational.shared_scope(mine, "id", []).count() == 2
    assert [r.id for r in relational.in_scope(mine, "id", ["b", "c"]).collect()] == ["b"]
    more = df.unionByName(spark.createDataFrame([(2, "z")], "owner int, id string"))
    assert relational.scoped(more, "owner", 1).count() == mine.count()
    with pytest.raises(ValueError):
        relational.page(df, [F.col("id")], limit=0)


def test_wildcards_are_literal(spark):
    df = spark.createDataFrame([("50%",), ("500",), ("a_b",), ("aXb",)], "t string")
    assert [r.t for r in relational.containing(df, "50%", "t").collect()] == ["50%"]
    assert [r.t for r in relational.containing(df, "A_B", "t").collect()] == ["a_b"]


@pytest.mark.parametrize(
    ("text_", "term", "status"),
    [
        ("No history of diabetes.", "diabetes", "absent"), ("Tuberculosis was ruled out.", "tuberculosis", "absent"), ("No chest pain but complains of fever.", "chest pain", "absent"),
        ("No chest pain but complains of fever.", "fever", "present"), ("History of hepatitis B in 2015.", "hepatitis", "historical"), ("Father had a heart attack at 50.", "heart attack", "family"),
        ("Mother reports the patient has asthma.", "asthma", "present"), ("Return to the clinic if you develop fever.", "fever", "hypothetical"), ("Impression: possible tuberculosis.", "tuberculosis", "uncertain"),
        ("No history of diabetes. Advised annual diabetes screening.", "diabetes", "uncertain"), ("Blood pressure 130/85.", "Type 2 diabetes mellitus", "present"), ("mujhe diabetes nahi hai", "diabetes", "absent"), ("", "x", "present"),
    ],
)
def test_status_of_a_mention(text_, term, status):
    assert text._status(text_, term)[0] == status


@pytest.mark.parametrize(
    ("text_", "term", "status"),
    [("مریض کو شوگر نہیں ہے", "diabetes", "absent"), ("mujhe sugar nahi hai", "diabetes", "absent"), ("مریض کو شوگر ہے", "diabetes", "present"), ("والد کو دمہ تھا", "asthma", "family"), ("mujhe bukhaar nahi", "fever", "absent"), ("no khansee today", "cough", "absent"), ("no sugary drinks", "diabetes", "present")],
)
def test_status_of_a_mention_in_local_spellings(text_, term, status):
    assert text._status(text_, term, catalogues.spellings())[0] == status


def test_history_of_an_empty_scope(spark):
    row = spark.createDataFrame([(1, 1, 1, None, True, "a")], "owner int, doc int, id int, day timestamp_ntz, active boolean, name string")
    tables = dict.fromkeys(pipelines.HISTORY_READS, row)
    assert pipelines.history_summary(tables, []).count() == 0 and pipelines.history_summary(tables, [1]).count() == 5


def test_assertion_column(spark):
    df = spark.createDataFrame([("No fever.", "fever"), (None, None)], "t string, w string")
    assert [r.assertion.status for r in text.assertions(df, "t", "w").collect()] == ["absent", "present"]


def test_sections_and_chunks(spark):
    body = "intro\nMedications:\nTab. A\n\nLab results\nHb 12\nmore\nImpression: fine"
    docs = spark.createDataFrame([(1, body, "report", "H"), (2, "", "report", None), (3, None, "report", None), (4, "word " * 1000, "note", None)], "id int, t string, kind string, h string")
    got = [(r.id, r.section, r.body) for r in text.sections(docs.where("id = 1"), "id", "t").orderBy("group").collect()]
    assert [g[1] for g in got] == ["General", "Medications", "Lab Results", "Diagnosis"] and got[1][2] == "Medications:\nTab. A"
    made = text.chunks(docs, "id", "t", "kind", "h").orderBy("id", "chunk").collect()
    assert {r.id for r in made} == {1, 4} and all(r.tokens <= 450 for r in made) and made[0].content.startswith("[Document: report, Hospital: H, Section: General]\n")
    assert sum(r.content.count("w") for r in made if r.id == 4) == 1000  # slices may cut a word, nothing is lost
    assert [r.chunk for r in made if r.id == 4] == list(range(sum(r.id == 4 for r in made)))


def test_rule_entities(spark):
    rows = [(1, "Tab. Metformin 850mg BD"), (2, "in april took Amlodipine"), (3, "Type 2  Diabetes with hypertension, HbA1c"), (4, "prediabetesX"), (5, "co-amoxicillin PO"), (6, "Amlodipine\namlodipine 5 mg"), (7, None), (8, ""), (9, "atorvastatin inhaler"), (10, "losartan xtabs")]
    docs = spark.createDataFrame(rows, "id int, t string")
    got = {(r.id, r.type, r.text, r.score) for r in text.rule_entities(docs, "id", "t").collect()}
    assert got == {
        (1, "medication", "Metformin", 0.75), (1, "dosage", "850mg", 1.0), (1, "frequency", "BD", 1.0), (2, "medication", "Amlodipine", 0.4), (3, "condition", "Type 2  Diabetes", 0.9), (3, "condition", "hypertension", 0.9), (3, "lab_test", "HbA1c", 0.9),
        (5, "medication", "co-amoxicillin", 0.75), (6, "medication", "amlodipine", 0.75), (6, "dosage", "5 mg", 1.0), (9, "medication", "atorvastatin", 0.75), (10, "medication", "losartan", 0.4),
    }


def test_linking_repeats_and_nulls(spark):
    labs = spark.createDataFrame([("SGPT",), ("SGPT",), (None,), ("nothing",)], "n string")
    got = linking.link_analytes(labs, catalogues.analytes(spark), "n").collect()
    assert sorted((r.n or "", r.key) for r in got if r.key) == [("SGPT", "alt")] * 2 and len(got) == 4


def test_resolved_concepts(spark):
    names = spark.createDataFrame([("Aspirin ", None), ("Aspirin", "1"), ("mystery", None)], "name string, rxcui string")
    concepts = spark.createDataFrame([("1", "aspirin", [], ["X"])], "rxcui string, name string, ingredients array<string>, classes array<string>")
    got = {r.name: (r.rxcui, r.ingredients) for r in safety.resolved(names, concepts).collect()}
    assert got == {"Aspirin": ("1", ["aspirin"]), "mystery": (None, [])}


def test_hybrid_merge_of_one_arm(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1)], "query_id int, id int, score double, rank int")
    none = spark.createDataFrame([], "query_id int, id int, score double, rank int")
    row = retrieval.fused(dense, none, "id").first()
    assert row.arms == "dense" and abs(row.rrf - 1 / 61) < 1e-12
    assert retrieval.fused(none, dense, "id").first().similarity is None


def test_coverage(spark):
    df = spark.createDataFrame([(["platelet"], "Platelets low"), (["hb"], "Hbsag"), ([], "x"), (["a1c", "sugar"], "a1c")], "terms array<string>, t string")
    got = [round(r[0], 4) for r in df.select(retrieval.coverage(F.col("terms"), F.col("t"))).collect()]
    assert got == [1.0, 0.0, 0.0, round(2 / 3.2, 4)]


def test_budget_first_block_is_free(spark):
    df = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 5)], "g int, o int, c int")
    assert {(r.g, r.o) for r in budget.prefix(df, ["g"], [F.col("o")], "c", 10).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert {(r.g, r.o) for r in budget.suffix(df, ["g"], [F.desc("o")], "c", 10).collect()} == {(1, 2), (2, 3), (2, 2)}


def test_published_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for v, n in (("1", 3), ("2", 5)):
        records.publish(spark.range(n), root, v)
        assert records.current(spark, root).count() == n


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-28",), ("1850-01-01",), ("03/04/2020",), ("junk",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(scalars.safe_day(F.col("d"), 2024)).collect()] == ["None", "2024-02-28", "None", "2020-04-03", "None", "None"]


def test_uploads_and_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfeh\x00i\x00")
    (tmp_path / "c.txt").write_bytes("سلام".encode("cp1256"))
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.exe").write_bytes(b"x")
    files = tables.uploads(spark, f"file://{tmp_path}")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.decode_legacy(files, "content").collect()}
    assert got == {"a.txt": "é", "b.txt": "hi", "c.txt": "سلام"}


def test_docx(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:body><w:p><w:r><w:t>one &amp; two</w:t></w:r></w:p><w:p><w:r><w:t xml:space='preserve'>three</w:t></w:r></w:p></w:body>")
    df = spark.createDataFrame([(1, bytearray(raw.getvalue()))], "id int, raw binary")
    assert tables.docx_text(df, "raw", "id").first().text == "one & two\n\nthree"


def events(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=s), u) for k, (s, u) in enumerate([(0, 1), (10, 1), (20, 1), (30, 1), (59, 1), (60, 1), (61, 1), (5, 2), (300, 1), (301, 1)])]
    return spark.createDataFrame(rows, "id long, ts timestamp, user long")


def test_limiter_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    want = {(r.user, r.id, r.accepted, r.retry_after) for r in limits.limited(e, ["user"], "ts", "id", 3, 60).collect()}
    assert (1, 3, False, 30) in want and (1, 5, True, None) in want
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    out = limits.limited_stream(live, {"user": "long"}, "ts", "id", 3, 60)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.user, r.id, r.accepted, r.retry_after) for r in spark.table("limited").collect()}
    assert got == want


def test_sweep(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, "processing", t(1, 0), t(1, 0), None), (2, "processing", None, t(1, 0), "n"), (3, "processing", t(1, 50), t(1, 0), None), (4, "done", t(1, 0), t(1, 0), None), (5, "processing", None, None, None)]
    w = spark.createDataFrame(rows, "id int, status string, started_at timestamp_ntz, updated_at timestamp_ntz, note string")
    assert {r.id for r in limits.stalled(w, "2024-01-01 02:00:00").collect()} == {1, 2}
    assert {r.id: r.status for r in limits.swept(w, "2024-01-01 02:00:00").collect()} == {1: "failed", 2: "failed", 3: "processing", 4: "done", 5: "processing"}


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("running", "run"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("happily", "happili"), ("conditional", "condit"), ("agreed", "agre"), ("skies", "sky"), ("controlled", "control"), ("adjustment", "adjust"), ("bus", "bus"), ("gas", "gas"), ("this", "this"), ("by", "by"), ("say", "say")])
def test_stems(word, want):
    from vitaloom.functions.stem import stem

    assert stem(word) == want


def test_lexical_stems(spark):
    chunks = spark.createDataFrame([(1, "diabetic patients running"), (2, "a patient ran")], "id int, t string")
    q = spark.createDataFrame([(1, ["patients", "runs"])], "query_id int, terms array<string>")
    assert {(r.id, round(r.score, 1)) for r in retrieval.lexical_arm(chunks, q, "id", "t", stems=True).collect()} == {(1, 0.2), (2, 0.1)}


def test_english_terms_and_expansion(spark):
    q = spark.createDataFrame([(0, "mujhe khansi aur bukhar hai phir bukhar"), (1, "shugar"), (2, "amlodipine"), (3, "malaria"), (4, "بخار اور شوگر"), (5, ""), (6, None)], "id int, q string")
    terms = pipelines.english_terms(q, catalogues.lexicon(spark), "id", "q").orderBy("id", "place").collect()
    assert [(r.id, r.english) for r in terms] == [(0, "cough"), (0, "fever"), (1, "diabetes"), (4, "fever"), (4, "diabetes")]  # malaria is English already
    out = {r.id: r.added for r in pipelines.expanded(q, catalogues.lexicon(spark), catalogues.SYNONYMS, catalogues.conditions(spark), "id", "q").collect()}
    assert out[1] == ["diabetes", "type", "mellitus"] and out[2] == [] and out[5] == [] and out[6] == []
    assert out[0] == ["cough", "fever"] and out[4][:2] == ["fever", "diabetes"]
    assert out[3] == ["plasmodium", "infection"]


def test_expansion_keeps_its_limit(spark):
    q = spark.createDataFrame([(0, "sugar ki bimari dama tibi pilia khansi bukhar ulti qabz wazan dil jigar")], "id int, q string")
    assert len(pipelines.expanded(q, catalogues.lexicon(spark), catalogues.SYNONYMS, catalogues.conditions(spark), "id", "q", 4).first().added) == 4


def test_retries_wait_and_give_up():
    waits, calls = [], []

    def failing(n):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise OSError(len(calls))
            return "done"

        return call

    assert providers.retried(failing(2), lambda e: ("transient", None), sleep=waits.append) == "done" and waits == [1.0, 4.0]
    calls.clear(), waits.clear()
    assert providers.retried(failing(1), lambda e: ("rate_limit", 12.2), sleep=waits.append) == "done" and waits == [12.45]
    for kind, suggested, n in (("permanent", None, 1), ("rate_limit", 46.0, 1), ("transient", None, 3)):
        calls.clear()
        with pytest.raises(OSError):
            providers.retried(failing(n), lambda e: (kind, suggested), sleep=waits.append)
        assert len(calls) == n


def test_calls_keep_their_order(spark):
    def call(batches):
        for b in batches:
            yield b.assign(v=b["v"] * 2)

    rows = providers.called(spark.range(100).select((99 - F.col("id")).alias("k"), F.col("id").alias("v")), 3, call, "k long, v long", "k").collect()
    assert [r.k for r in rows] == list(range(100)) and rows[5].v == 188


def test_inserted_rows_are_stored(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "done")], "id int, status string")
    path = str(tmp_path / "t")
    for _ in range(2):
        assert {(r.id, r.status) for r in records.inserted(rows, {"status": "pending"}, path).collect()} == {(1, "pending"), (2, "done")}
    assert spark.read.parquet(path).count() == 4


def test_concepts_by_blank_ids_and_own_names(spark):
    names = spark.createDataFrame([("Panadol", " "), (" Panadol", "161"), ("", "5"), (None, None)], "name string, rxcui string")
    concepts = spark.createDataFrame([("161", "paracetamol", [], [])], "rxcui string, name string, ingredients array<string>, classes array<string>")
    assert [(r.name, r.rxcui, r.ingredients) for r in safety.resolved(names, concepts).collect()] == [("Panadol", "161", ["panadol"])]


def test_bodies_go_through_python_in_portions():
    import pyarrow as pa

    b = pa.record_batch({"id": pa.array(range(7)), "body": pa.array(["a" * 10, "b" * 30, None, "", "é" * 6, "c", "d"])})
    got = list(text._portions(b, "body", 12))
    assert [i for x in got for i in x.column("id").to_pylist()] == list(range(7)) and len(got) > 2
    assert list(text._portions(b.slice(0, 0), "body", 12)) == []


def test_words_that_end_as_drugs_do(spark):
    """The one pattern finds what words cut first and looked at then give."""
    said = "Metformin x-olol-METFORMIN, -amlodipine cillin azolez nib ketoconazole9 éazole Ranitidine-b prilosec mab-mab tinib-9 statin_in warfarinolol--"
    df = spark.createDataFrame([(said,)], "t string")
    old = F.filter(F.regexp_extract_all("t", F.lit(r"\p{L}[\p{L}-]{4,}"), F.lit(0)), lambda w: F.rlike(w, F.lit(f"(?i)(?:{text.fixed.DRUG_ENDINGS})$")))
    row = df.select(old.alias("old"), F.regexp_extract_all("t", F.lit(text._DRUG), F.lit(0)).alias("new")).first()
    assert row.new == row.old and len(row.old) > 4
