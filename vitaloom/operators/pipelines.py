"""Whole flows made of the operators: ingestion rows, reconciliation, interaction check, prompt, history, shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars
from vitaloom.operators import linking, relational, retrieval, safety, text


def found_terms(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place, matched, english, kind: local terms of a text, longest first from left to right, without overlap.

    A run of words is a term by its folded script if a letter of it is in that script, else by the words themselves, else by their sound, in which words
    without Latin letters count nothing. Each place meets the lexicon by its first word in one equi-join and is compared there with the words that follow, as many as
    the longest spelling has; the greedy choice is a fold over a text's few matches.
    """
    spelt = linking.spelling_index(lexicon).withColumn("full", F.substring("key", 3, 1 << 20))
    spelt = spelt.select(F.concat(F.left("key", F.lit(2)), F.element_at(F.split("full", " "), 1)).alias("k"), F.left("key", F.lit(1)).alias("how"), "full", "english", F.col("kind").alias("_kind"))
    longest = lexicon.select(F.max(F.array_max(F.transform(F.concat("urdu", "roman"), lambda p: F.size(F.split(F.trim(p), r"\s+")))))).scalar()
    words = F.filter(F.split(scalars.urdu_normal(F.col(text_col)), fixed.TERM_SEPARATORS), lambda w: w != "")
    at = docs.select(id_col, words.alias("_w"), longest.alias("_l")).where(F.size("_w") > 0)
    at = at.withColumn("_k", F.transform("_w", scalars.sound_key))
    spans = F.transform("_w", lambda w, i: F.struct((i + 1).alias("i"), F.slice("_w", i + 1, F.col("_l")).alias("w"), F.slice("_k", i + 1, F.col("_l")).alias("k")))
    place = at.select(id_col, F.explode(spans).alias("s")).select(id_col, "s.*")
    heard = F.get(F.array_remove("k", ""), F.lit(0))
    keys = F.array(F.concat(F.lit("u:"), F.get("w", F.lit(0))), F.concat(F.lit("l:"), F.lower(F.get("w", F.lit(0)))), F.concat(F.lit("p:"), heard))
    near = place.select(id_col, "i", "w", F.col("k").alias("sounds"), F.explode(F.array_compact(keys)).alias("k")).join(spelt, "k")
    joined = lambda xs: F.array_join(xs, " ")

    def holds(n: Column) -> Column:
        own, how, full = F.slice("w", F.lit(1), n), F.col("how"), F.col("full")
        script = F.exists(own, scalars.has_urdu)
        by_sound = joined(F.array_remove(F.slice("sounds", F.lit(1), n), ""))
        return F.when(how == "u", script & (joined(own) == full)).when(how == "l", ~script & (F.lower(joined(own)) == full)).otherwise(~script & (by_sound == full))

    span = F.array_max(F.filter(F.sequence(F.lit(1), F.size("w")), holds))
    hits = near.withColumn("n", span).where("n IS NOT NULL")
    best = hits.groupBy(id_col, "i").agg(F.min_by(F.struct("n", joined(F.slice("w", F.lit(1), F.col("n"))).alias("p"), "english", F.col("_kind").alias("kind")), F.struct(-F.col("n"), F.col("how") == "p")).alias("b"))
    folded = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "b.*"))).alias("h"))
    none = F.array().cast("array<struct<i:int,n:int,p:string,english:string,kind:string>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("out"))
    taken = F.aggregate("h", start, lambda a, x: F.when(x["i"] >= a["end"], F.struct((x["i"] + x["n"]).alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a))["out"]
    return folded.select(id_col, F.explode(taken).alias("t")).select(id_col, F.col("t.i").alias("place"), F.col("t.p").alias("matched"), F.col("t.english").alias("english"), F.col("t.kind").alias("kind"))


def diagnosis_rows(diagnoses: DataFrame, conditions: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc, condition, status …) → rows to store: own findings only, cut to width, canonical name at any confidence, code from 0.85."""
    linked = linking.link_conditions(text.own_findings(diagnoses, "status"), conditions, "condition", lexicon)
    return linked.select("doc", scalars.clamped(F.col("condition"), 300).alias("condition"), F.coalesce("canonical", "condition").alias("canonical_condition"), linking.suggested_code(F.col("confidence"), F.col("code")).alias("icd10_code"), "status").where("condition IS NOT NULL")


def medication_rows(medications: DataFrame) -> DataFrame:
    """(doc, fields of an extracted medication) → rows to store: named ones only, cut to width, in use unless it says otherwise."""
    cut = {"name": 500, "genericName": 500, "dosage": 255, "frequency": 255, "duration": 255, "route": 100, "rxnormId": 50}
    fields = [scalars.clamped(F.col(c), n).alias(c) for c, n in cut.items()]
    return medications.select("doc", *fields, F.coalesce("isActive", F.lit(True)).alias("isActive")).where("name IS NOT NULL")


def lab_rows(labs: DataFrame, analytes: DataFrame) -> DataFrame:
    """(doc, fields of an extracted lab result) → rows to store: with a name and a value, which the number gives if there is no text.

    A number comes from the text first; out of range is what the record says, else what its range says, else false.
    """
    number = scalars.measured_value(F.col("value"))["value"]
    kept = labs.withColumns({"value": scalars.clamped(F.coalesce("value", F.col("numericValue").cast("string")), 100), "number": F.coalesce(number, F.col("numericValue"))})
    kept = kept.withColumn("testName", scalars.clamped(F.col("testName"), 500)).where("testName IS NOT NULL AND value IS NOT NULL")
    linked = linking.canonical_labs(kept, analytes, "testName", "number", "unit")
    flag = scalars.abnormal(F.col("isAbnormal"), F.col("number"), scalars.reference_range(F.col("referenceRange")))
    return linked.select(
        "doc", "testName", F.col("key").alias("canonicalTestName"), "canonical_value", F.when(F.col("canonical_value").isNotNull(), F.col("canonical_unit")).alias("canonical_unit"), "value", F.col("number").alias("numericValue"),
        scalars.clamped(F.col("unit"), 100).alias("unit"), scalars.clamped(F.col("referenceRange"), 255).alias("referenceRange"), flag.alias("isAbnormal"),
    )


def allergy_rows(allergies: DataFrame) -> DataFrame:
    """(doc, fields of an extracted allergy) → rows to store: own ones with an allergen, cut to width; no status means present."""
    status = F.coalesce("assertionStatus", F.lit("present"))
    own = text.own_findings(allergies.withColumn("assertionStatus", status), "assertionStatus")
    return own.select("doc", scalars.clamped(F.col("allergen"), 500).alias("allergen"), scalars.clamped(F.col("allergyType"), 100).alias("allergyType"), scalars.clamped(F.col("severity"), 100).alias("severity"), "reaction", "assertionStatus").where("allergen IS NOT NULL")


def status_note(term: Column, a: Column) -> Column:
    """What a reader is told of a mention's status (``a``: status, cue, evidence, contradiction); null where it needs no word."""
    some = lambda before, c, after: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    because, quote = some(' ("', a["cue"], '")'), some(' — "', a["evidence"], '"')
    said = {status: F.concat(*[{"term": term, "because": because, "quote": quote}.get(p, F.lit(p)) for p in parts]) for status, parts in fixed.STATUS_NOTES.items()}
    both = F.concat(*[{"term": term, "denied": a["contradiction"], "asserted": a["evidence"]}.get(p, F.lit(p)) for p in fixed.CONTRADICTION_NOTE])
    out = F.when(a["contradiction"].isNotNull(), both)
    for status, note in said.items():
        out = out.when(a["status"] == status, note)
    return out


def _noted(rows: DataFrame, order: list[str], note: str, most: int | None = None) -> Column:
    """The notes of grouped rows in order, ``most`` of them at most."""
    notes = F.transform(F.array_sort(F.collect_list(F.struct(*order, note))), lambda x: x[note])
    return F.slice(notes, 1, most) if most else notes


def reconciled(docs: DataFrame, record: dict[str, DataFrame], conditions: DataFrame, lexicon: DataFrame, spellings: dict[str, tuple[list[str], list[str]]], candidates: DataFrame) -> DataFrame:
    """doc, notes, missed, held_back, linked, identified: a record held against the text that it was read from.

    docs: (doc, text); record: ``medications`` (doc, place, name, genericName), ``diagnoses`` (doc, place, condition, icd10Code), ``allergies`` (doc, place, allergen),
    ``labs`` (doc, place, testName); candidates of drug names as for :func:`linking.drug_matches`. Notes tell of drug names that the dictionary spells otherwise, of
    entities by rule that the record lacks, and of findings that the text denies, gives to a relative or only speaks of. A name is looked up and a (doc, term) pair classified once.
    """
    meds = record["medications"].where("name IS NOT NULL")
    drugs = linking.drug_matches(meds.select("name").distinct().withColumnRenamed("name", "raw"), candidates, "raw").where("rxcui IS NOT NULL")
    known = meds.join(drugs.withColumnRenamed("name", "drug"), F.col("name") == F.col("raw"), "left").withColumn("genericName", F.coalesce("genericName", "drug"))
    read = known.where("corrected").withColumn("said", F.concat(F.lit('"'), "raw", F.lit('" → '), "drug"))
    identified = read.groupBy("doc").agg(_noted(read, ["place"], "said").alias("_drugs"))

    terms = record["diagnoses"].select("doc", F.lit(0).alias("part"), "place", F.col("condition").alias("term")).union(record["allergies"].select("doc", F.lit(1), "place", F.col("allergen")))
    terms = terms.where("term IS NOT NULL AND term <> ''").groupBy("doc", "term").agg(F.min(F.struct("part", "place")).alias("at"))
    status = text.assertions(terms.join(docs.select("doc", "text"), "doc"), "text", "term", spellings).withColumn("note", status_note(F.col("term"), F.col("assertion")))
    denied = status.where(~F.col("assertion.status").isin(*fixed.OWN_STATUSES))
    held = denied.groupBy("doc").agg(_noted(denied, ["at"], "term").alias("held_back"), _noted(denied, ["at"], "note", fixed.MOST_NOTES).alias("_held"))

    said = lambda rows, c, kind: rows.select("doc", F.lit(kind).alias("type"), F.col(c).alias("name")).where("name IS NOT NULL")
    parts = ((known, "name", "medication"), (known, "genericName", "medication"), (record["allergies"], "allergen", "medication"), (record["diagnoses"], "condition", "condition"), (record["labs"], "testName", "lab_test"))
    mentioned = reduce(DataFrame.union, (said(*p) for p in parts))
    lacking = safety.missed(text.rule_entities(docs, "doc", "text"), mentioned)
    missed = lacking.groupBy("doc").agg(_noted(lacking, ["place"], "text").alias("missed"))

    given = record["diagnoses"].where("condition IS NOT NULL AND icd10Code IS NULL").select("doc", "condition")
    coded = linking.link_conditions(given, conditions, "condition", lexicon).where(linking.suggested_code(F.col("confidence"), F.col("code")).isNotNull())
    linked = coded.groupBy("doc").agg(F.count("*").alias("linked"))

    none = F.array().cast("array<string>")
    out = reduce(lambda a, b: a.join(b, "doc", "left"), (identified, held, missed, linked), docs.select("doc"))
    out = out.select("doc", *(F.coalesce(c, none).alias(c) for c in ("_drugs", "_held", "held_back", "missed")), F.coalesce("linked", F.lit(0)).alias("linked"))
    shown = F.concat(F.array_join(F.slice("missed", 1, fixed.MOST_NOTES), ", "), F.when(F.size("missed") > fixed.MOST_NOTES, F.concat(F.lit(", and "), (F.size("missed") - fixed.MOST_NOTES).cast("string"), F.lit(" more"))).otherwise(""))
    first = F.when(F.size("_drugs") > 0, F.concat(F.lit(fixed.DRUG_NOTE[0]), F.array_join("_drugs", ", "), F.lit(fixed.DRUG_NOTE[1])))
    second = F.when(F.size("missed") > 0, F.concat(F.lit(fixed.MISSED_NOTE[0]), shown, F.lit(fixed.MISSED_NOTE[1])))
    return out.select("doc", F.concat(F.array_compact(F.array(first, second)), "_held").alias("notes"), "missed", "held_back", "linked", F.size("_drugs").alias("identified"))


def interaction_check(drugs: DataFrame, current: DataFrame, allergies: DataFrame) -> DataFrame:
    """drug, kind, item, severity of all findings, in the order allergy, ingredient, class for each drug (``place``)."""
    a = safety.allergy_findings(drugs, allergies).select("drug", F.lit(0).alias("place"), F.lit("allergy").alias("kind"), F.col("allergen").alias("item"), F.col("level").alias("severity"))
    i = safety.shared_ingredients(drugs, current).select("drug", F.lit(1).alias("place"), F.lit("ingredient").alias("kind"), F.col("medication").alias("item"), F.lit("moderate").alias("severity"))
    c = safety.shared_classes(drugs, current).select("drug", F.lit(2).alias("place"), F.lit("class").alias("kind"), F.col("medication").alias("item"), F.lit("mild").alias("severity"))
    return a.unionByName(i).unionByName(c)


def share_views(links: DataFrame, token: str, as_of: object) -> DataFrame:
    """Links with one more view where the token is live; the expiry instant itself is too late."""
    live = (F.col("token") == token) & F.coalesce(F.col("is_active"), F.lit(False)) & (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
    return links.withColumn("view_count", F.when(live, F.coalesce("view_count", F.lit(0)) + 1).otherwise(F.col("view_count")))


def expired(expires_at: Column, as_of: object) -> Column:
    """As the list of links shows it: from the expiry instant on."""
    return expires_at <= F.lit(as_of).cast("timestamp_ntz")


def listed(items: Column, cap: int) -> Column:
    """First ``cap`` items and how many more there are."""
    more = F.greatest(F.lit(0), F.size(items) - cap)
    return F.concat(F.array_join(F.slice(items, 1, cap), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def prompt(excerpts: DataFrame, turns: DataFrame, profile: DataFrame, budget_tokens: int = fixed.PROMPT_TOKENS) -> DataFrame:
    """query_id, context, history: excerpts within what the profile leaves (1000 at least), newest turns within their own budget.

    excerpts: (query_id, rank, title, section, content); turns: (query_id, turn, role, content); profile: (query_id, profile).
    """
    from vitaloom.operators import budget

    room = profile.select("query_id", F.greatest(F.lit(1000), budget_tokens - scalars.token_estimate(F.col("profile"))).alias("room"))
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(': "'), "title", F.lit('" — '), "section", F.lit("]\n"), "content")
    costed = excerpts.withColumn("block", block).withColumn("cost", scalars.token_estimate(F.col("block"))).join(room, "query_id")
    fits = budget.prefix(costed, ["query_id"], [F.col("rank")], "cost", F.col("room"))
    context = fits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))
    said = budget.suffix(turns.withColumn("cost", scalars.token_estimate(F.col("content"))), ["query_id"], [F.desc("turn")], "cost")
    history = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("history"))
    return profile.select("query_id").join(context, "query_id", "left").join(history, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("No relevant documents found.")))


def relative_day(day: Column, as_of: Column) -> Column:
    n = F.datediff(as_of, day)
    return F.when(n == 0, "Today").when(n == 1, "Yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def summary_language(preferred: Column, written: Column) -> Column:
    return F.when(preferred.isin("en", "ur"), preferred).otherwise(written)


#: Reads of a history: how each is ordered, newest first with unknown dates before.
HISTORY_READS = ("documents", "medications", "diagnoses", "labs", "allergies")


def history_summary(tables: dict[str, DataFrame], ids: list | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """owner, part, id of every owner's history: five reads, each with its cap, and of labs the newest of a name among the capped rows.

    Each table has (owner, doc, id, day); medications also ``active``, of which only true counts, and labs ``name``. ``ids``: the
    documents in scope; an empty list reads nothing. Allergies come by id, which has no date to go by.
    """
    caps, out = caps or fixed.HISTORY_CAPS, None
    for part in HISTORY_READS:
        rows = relational.in_scope(tables[part], "doc", ids)
        if part == "medications":
            rows = rows.where(F.coalesce("active", F.lit(False)))
        order = [F.col("id").asc()] if part == "allergies" else relational.newest_first("day", ties="id")
        rows = relational.capped(rows, order, caps[part], "owner")
        if part == "labs":
            rows = relational.latest_per_key(rows.withColumn("name", F.lower("name")), ["owner", "name"], order)
        rows = rows.select("owner", F.lit(part).alias("part"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def english_terms(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place, english: English words for the local terms of a text, each once where it first stands, none that is English already."""
    found = found_terms(docs, lexicon, id_col, text_col).where(F.lower("matched") != F.lower("english"))
    return found.groupBy(id_col, "english").agg(F.min("place").alias("place")).select(id_col, "place", "english")


#: A condition gives its name and this many other names to a question.
CONDITION_ALIASES = 2


def expanded(queries: DataFrame, lexicon: DataFrame, synonyms: dict[str, list[str]], conditions: DataFrame, id_col: str, text_col: str, limit: int = fixed.EXPANSION_LIMIT) -> DataFrame:
    """id, added: words for a search beside the query's own. English for its local terms come first, then synonyms of the query and of
    those terms, then names of the conditions that either links to surely enough to be coded; each word once, ``limit`` at most. A null query gets none."""
    none = F.array().cast("array<string>")
    terms = english_terms(queries, lexicon, id_col, text_col).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "english"))), lambda t: t["english"]).alias("terms"))
    asked = queries.select(id_col, F.col(text_col).alias("q")).join(terms, id_col, "left").withColumn("terms", F.coalesce("terms", none))
    phrases = asked.select(id_col, F.posexplode(F.concat(F.array("q"), "terms")).alias("at", "phrase"))
    names = linking.link_conditions(phrases, conditions, "phrase", lexicon).join(conditions.select("code", "canonical", "aliases"), ["code", "canonical"], "left")
    sure = F.when(F.col("confidence") >= 0.85, F.concat(F.array("canonical"), F.slice("aliases", 1, CONDITION_ALIASES)))
    given = names.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", retrieval.expand(F.col("phrase"), synonyms, 1 << 20).alias("s"), F.coalesce(sure, none).alias("c")))).alias("g"))
    every = F.concat("terms", F.flatten(F.transform("g", lambda x: x["s"])), F.flatten(F.transform("g", lambda x: x["c"])))
    words = F.flatten(F.transform(every, scalars.content_terms))
    out = asked.join(given, id_col, "left")
    return out.select(id_col, F.coalesce(F.slice(F.array_except(words, scalars.content_terms(F.col("q"))), 1, limit), none).alias("added"))


def summary_section(owners: DataFrame, rows: DataFrame, owner: str, heading: str, line: Column, order: list[str]) -> DataFrame:
    """owner, section: a heading with the number of rows, then a line each in order, or that there are none."""
    lines = rows.select(owner, F.struct(*order, line.alias("said")).alias("l")).groupBy(owner).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: F.concat(F.lit("  - "), l["said"])), "\n").alias("said"))
    head = F.format_string(heading + " (%d):", F.coalesce("n", F.lit(0)))
    return owners.join(lines, owner, "left").select(owner, F.concat(head, F.lit("\n"), F.coalesce("said", F.lit("  None recorded"))).alias("section"))


def medication_line(name: Column, dosage: Column, frequency: Column, active: Column) -> Column:
    some = lambda before, c: F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit(""))), F.lit(""))
    return F.concat(name, some(" ", dosage), some(", ", frequency), F.when(active, "").otherwise(F.when(active.isNull(), "").otherwise(" (inactive)")))


def lab_line(name: Column, value: Column, unit: Column, abnormal: Column, range_: Column) -> Column:
    unit_, within = F.coalesce(F.concat(F.lit(" "), F.nullif(unit, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" (ref: "), F.nullif(range_, F.lit("")), F.lit(")")), F.lit(""))
    return F.concat(name, F.lit(": "), value, unit_, F.when(abnormal, " [ABNORMAL]").otherwise(""), within)
