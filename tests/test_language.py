"""Local-language look-ups, composition, denials, reconciliation, entity lists, coverage and packing against plain statements."""

import random
import re
import sys
from pathlib import Path
import unicodedata

import pytest
from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars
from vitaloom.operators import linking, pipelines, records, retrieval, text
from vitaloom.plans import catalogues as cat


@pytest.mark.parametrize(
    ("phrase", "english"),
    [("khansi", "cough"), ("khaansi", "cough"), ("khansee", "cough"), ("KHANSI", "cough"), ("dama", "asthma"), ("pilia", "jaundice"), ("dm", None), ("bp", None), ("blood   pressure", "hypertension"), ("بخار", "fever"), ("بُخار", "fever"), ("test بخار", None), ("", None), ("12", None), ("saans ki bimaari", "asthma")],
)
def test_one_phrase(spark, phrase, english):
    df = spark.createDataFrame([(phrase, 1), (phrase, 2), (None, 3)], "p string, english int").drop("english")
    rows = linking.local_terms(df, cat.lexicon(spark), "p").collect()
    assert sorted((r.p is None, r.english) for r in rows) == sorted([(False, english), (False, english), (True, None)], key=str) or {(r.p, r.english) for r in rows} == {(phrase, english), (None, None)}


def test_composed_and_decomposed_spellings_link_alike(spark):
    """Every spelling of the lexicon that has another canonical form is found in both."""
    both = [(w, unicodedata.normalize(form, w)) for _, _, urdu, _ in cat.LEXICON for w in urdu for form in ("NFD", "NFC")]
    assert any(a != b for a, b in both)
    df = spark.createDataFrame(both, "a string, b string").select("a", "b", scalars.urdu_normal(F.col("a")).alias("x"), scalars.urdu_normal(F.col("b")).alias("y"))
    assert [r for r in df.collect() if r.x != r.y] == []


def test_composition_finds_every_character_it_touches(spark):
    changed = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    pairs = ["é", "가", "آ", "plain", "", "יִ"]
    rows = [(k, t) for k, t in enumerate([*changed, *pairs])] + [(-1, None)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", "t", scalars.composed(F.col("t")).alias("c")).collect()
    assert [r for r in got if r.c != (None if r.t is None else unicodedata.normalize("NFC", r.t))] == []


def test_conditions_in_local_words(spark):
    df = spark.createDataFrame([(w,) for w in ("dama", "pilia", "شوگر", "khansee", "jigar", "Asthma", "mareez", "xyz", "")], "raw string")
    got = {r.raw: (r.canonical, r.matched_on, r.confidence) for r in linking.link_conditions(df, cat.conditions(spark), "raw", cat.lexicon(spark)).collect()}
    assert got["dama"] == ("Asthma", "local-language", 0.85) and got["pilia"] == ("Jaundice", "local-language", 0.85) and got["Asthma"] == ("Asthma", "exact", 1.0)
    assert got["شوگر"] == ("Type 2 diabetes mellitus", "local-language", 0.85)
    assert all(got[w] == (None, None, None) for w in ("jigar", "mareez", "xyz", ""))  # no conditions: anatomy, general, unknown, nothing


def test_terms_of_a_text(spark):
    rows = [(1, "khansee,Dama;bukhaar/ulti (qabz)"), (2, "خون کی کمی اور بخار"), (3, "12 khansi"), (4, None), (5, "..."), (6, "saans ki bimari mein dil"), (7, "dm bp"), (8, "zyada khansi khansi"), (9, "khoon ki")]
    got = {}
    found = pipelines.found_terms(spark.createDataFrame(rows, "id int, t string"), cat.lexicon(spark), "id", "t")
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.place, r.matched, r.english, r.kind))
    assert got == {
        1: [(1, "khansee", "cough", "symptom"), (2, "Dama", "asthma", "condition"), (3, "bukhaar", "fever", "symptom"), (4, "ulti", "vomiting", "symptom"), (5, "qabz", "constipation", "symptom")],
        2: [(1, "خون کی کمی", "anemia", "condition"), (5, "بخار", "fever", "symptom")], 3: [(1, "12 khansi", "cough", "symptom")], 6: [(1, "saans ki bimari", "asthma", "condition"), (5, "dil", "heart", "anatomy")],
        8: [(2, "khansi", "cough", "symptom"), (3, "khansi", "cough", "symptom")], 9: [(1, "khoon", "blood", "anatomy")],
    }


def test_terms_are_as_long_as_the_lexicon_says(spark):
    """No bound on words of a spelling but that of the lexicon itself."""
    long_one = " ".join(f"lafz{c}" for c in "abcdefgh")
    lexicon = cat.lexicon(spark).union(spark.createDataFrame([("long thing", "symptom", [], [long_one], 1000)], cat.lexicon(spark).schema))
    found = pipelines.found_terms(spark.createDataFrame([(1, f"x {long_one} y")], "id int, t string"), lexicon, "id", "t").collect()
    assert [(r.place, r.english) for r in found] == [(2, "long thing")]


def record(spark, diagnoses=(), drugs=(), allergies=(), labs=()):
    make = lambda rows, schema: spark.createDataFrame([(d, k, *r) for k, (d, *r) in enumerate(rows)], f"doc int, place int, {schema}")
    return {"diagnoses": make(diagnoses, "condition string, icd10Code string"), "medications": make(drugs, "name string, genericName string"), "allergies": make(allergies, "allergen string"), "labs": make(labs, "testName string")}


CANDIDATES = [("Metformn", "6809", "metformin", 9.1, 1, "RXNORM"), ("Amlodipin", "17767", "amlodipine", 8.1, 2, "RXNORM")]


def reconciled(spark, docs, **parts):
    candidates = spark.createDataFrame(CANDIDATES, "query string, rxcui string, name string, score double, rank int, source string")
    out = pipelines.reconciled(spark.createDataFrame(docs, "doc int, text string"), record(spark, **parts), cat.conditions(spark), cat.lexicon(spark), cat.spellings(), candidates)
    return {r.doc: r for r in out.collect()}


def test_denials_in_two_languages_are_held_back(spark):
    got = reconciled(spark, [(1, "مریض کو شوگر نہیں ہے"), (2, "mujhe dama nahi hai"), (3, "no asthma"), (4, "has asthma"), (5, None)], diagnoses=[(1, "diabetes", None), (2, "asthma", None), (3, "asthma", None), (4, "asthma", "X1"), (5, "asthma", None)])
    assert {d: list(r.held_back) for d, r in got.items()} == {1: ["diabetes"], 2: ["asthma"], 3: ["asthma"], 4: [], 5: []}
    assert {d: r.linked for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}  # a code that the document printed stays its own
    assert got[3].notes == ['"asthma" was left out of your record because the document says you do not have it ("no") — "no asthma".'] and got[4].notes == []


def test_notes_of_a_record(spark):
    body = "Tab Metformn 500 mg bd. " + " ".join(f"{w} inhaler" for w in ("losartan", "ramipril", "omeprazole", "cetirizine", "diclofenac sodium", "ibuprofen", "ciprofloxacin", "enalapril")) + ". Penicillin allergy."
    got = reconciled(spark, [(1, body), (2, "Mother had asthma. If fever comes back, return.")], drugs=[(1, "Metformn", None), (1, "Losartan 50mg", None)], allergies=[(1, "Penicillin")], diagnoses=[(2, "asthma", None), (2, "fever", None)])
    one = got[1]
    assert one.identified == 1 and one.notes[0] == fixed.DRUG_NOTE[0] + '"Metformn" → metformin' + fixed.DRUG_NOTE[1]
    assert list(one.missed) == ["ramipril", "omeprazole", "ibuprofen", "ciprofloxacin", "enalapril", "sodium"] and ", ".join(one.missed[:5]) + ", and 1 more" in one.notes[1]
    assert list(got[2].held_back) == ["asthma", "fever"] and got[2].notes[0].startswith('"asthma" was recorded as family history') and "advice about what to do" in got[2].notes[1]


def test_lists_that_a_question_names(spark):
    rows = [(0, '{"drugs":["Panadol"," x "],"foods":[" "],"supplements":"none"}'), (1, '{"drugs":[' + ",".join(['"a"'] * 31) + '],"foods":["' + "y" * 201 + '"]}'), (2, "no"), (3, None)]
    got = {r.k: (r.e.drugs, r.e.foods, r.e.supplements) for r in spark.createDataFrame(rows, "k int, raw string").select("k", records.asked_entities(F.col("raw")).alias("e")).collect()}
    assert got == {0: (["Panadol", "x"], [], []), 1: ([], [], []), 2: ([], [], []), 3: ([], [], [])}


def test_coverage_by_join_equals_coverage_by_row(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["met", "metformin", "metf", "dose", "doses", "500mg", "500", "the", "x", "sugar", "sugars", "Ünï", "日本", "a1"])
    chunks = spark.createDataFrame([(k, ", ".join(word() for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(60, None)], "id int, text string")
    queries = spark.createDataFrame([(q, [word().lower() for _ in range(rng.randint(0, 5))] + [""] * (q % 2)) for q in range(12)], "query_id int, terms array<string>")
    finds = queries.select("query_id").crossJoin(chunks.select("id")).where("(query_id + id) % 3 > 0")
    got = {(r.query_id, r.id): round(r.coverage, 9) for r in retrieval.covered(finds, queries, chunks, "id", "text").collect()}
    want = finds.join(queries, "query_id").join(chunks, "id").select("query_id", "id", retrieval.coverage(F.col("terms"), F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert got == {(r.query_id, r.id): round(r.c, 9) for r in want} and len(got) > 300


def plain_estimate(t):
    arabic = sum("؀" <= c <= "ۿ" or "ﭐ" <= c <= "﷿" for c in t)
    size = len(t) + sum(ord(c) > 0xFFFF for c in t)
    return max(1, -int(-(arabic / 2.5 + (size - arabic) / 4) // 1))


def test_packing_keeps_to_the_estimate_of_what_is_joined():
    """Running sums give the packing that measuring each joined text would."""
    rng = random.Random(8)

    def naive(lines, budget):
        out, held = [], ""
        for line in lines:
            if held and plain_estimate(held + "\n" + line) > budget:
                out.append(held)
                held = line
            else:
                held = held + "\n" + line if held else line
        return [*out, held] if held else out

    for _ in range(200):
        lines = ["".join(rng.choice("ab ٢خ🎉é") for _ in range(rng.randint(1, 30))) + "x" for _ in range(rng.randint(1, 40))]
        assert all(text.estimate(line) == plain_estimate(line) for line in lines)
        assert text.packed("\n".join(lines), 40) == naive(lines, 40)


def plain_chunks(body, kind, source, budget=450):
    """Sections and chunks of one document as they are stated, each joined text measured anew: (section, content) in order."""
    groups, named = [], ""
    for k, line in enumerate(body.split("\n")):
        section = next((n for n, p in fixed.SECTIONS if re.search("(?i)" + p, line)), "General")
        if k == 0 or section not in ("General", named):
            groups.append((section, []))
        named = section if section != "General" else named
        groups[-1][1].append(line)

    def fill(units, glue, room, too_long):
        out, held = [], ""
        for unit in units:
            if plain_estimate(unit) > room:
                out += [held] * bool(held) + too_long(unit)
                held = ""
            elif held and plain_estimate(held + glue + unit) > room:
                out.append(held)
                held = unit
            else:
                held = held + glue + unit if held else unit
        return out + [held] * bool(held)

    def slices(sentence, room):
        size = max(fixed.LEAST_SLICE, int(room / (plain_estimate(sentence) / len(sentence))))
        return [p for k in range(0, len(sentence), size) if (p := sentence[k : k + size].strip())]

    out = []
    for section, lines in groups:
        if not any(line.strip() for line in lines):
            continue
        head = f"[{', '.join([f'Document: {kind}'] * (kind is not None) + [f'Hospital: {source}'] * (source is not None))}, Section: {section}]"
        room = max(fixed.LEAST_BODY_TOKENS, budget - plain_estimate(head))
        text_ = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", "\n".join(lines))
        parts = fill([x for x in text_.split("\n") if x.strip()], "\n", room, lambda x: fill([s for s in re.split(r"(?<=[.!?۔])\s+", x) if s], " ", room, lambda y: slices(y, room)))  # noqa: B023
        out += [(section, f"{head}\n{p}") for p in parts]
    return out


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_chunks_of_the_given_documents(spark):
    """Every chunk of every document of a small table, and of some odd ones, against the plain statement."""
    made = [(10**6, "Medications: aspirin. " * 300 + "\nno end " + "x" * 5000 + "\n\nLab results\n" + "شوگر کی بیماری۔ " * 400, "en", None), (10**6 + 1, "", "en", "s"), (10**6 + 2, " \n\t", None, "s"), (10**6 + 3, None, "en", "s")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").union(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"))
    got = {}
    for r in text.chunks(docs, "doc_id", "text", "lang", "source").orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.content))
        assert r.tokens == plain_estimate(r.content)
    want = {r.doc_id: c for r in docs.collect() if r.text is not None and (c := plain_chunks(r.text, r.lang, r.source))}
    assert got == want and len(want) > 150 and len(want[10**6]) > 10
