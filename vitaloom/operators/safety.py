"""Medication safety and reconciliation: joins between queried drugs, a profile, and what a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), c) - 1


def highest_severity(df: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """Highest severity of each group; info where none is known."""
    top = F.max(severity_rank(F.coalesce(F.col(severity), F.lit("info"))))
    return df.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, fixed.SEVERITIES)), F.coalesce(top, F.lit(0)).cast("int") + 1).alias("severity"))


def allergy_findings(drugs: DataFrame, allergies: DataFrame) -> DataFrame:
    """drug, allergen, severity, same_substance. drugs: (drug, ingredients, classes); allergies: (allergen, severity).

    Words of names, whole ingredients and words of class names become one key column each side, so it is an equi-join.
    """
    key = scalars.singular(scalars.plain_key(F.col("allergen")))
    words = lambda c: F.transform(F.split(scalars.plain_key(c), " "), scalars.singular)
    whole = F.transform("ingredients", lambda i: scalars.singular(scalars.plain_key(i)))
    keys = F.array_distinct(F.concat(words(F.col("drug")), whole, F.flatten(F.transform("classes", words))))
    left = drugs.select("drug", whole.alias("_own"), F.explode(keys).alias("_k"))
    found = left.join(allergies.withColumn("_k", key).where("_k <> ''"), "_k")
    same = F.contains(scalars.plain_key(F.col("drug")), F.col("_k")) | F.array_contains("_own", F.col("_k"))
    level = F.when(F.lower("severity") == "severe", "contraindicated").otherwise("severe")
    return found.select("drug", "allergen", level.alias("level"), same.alias("same_substance")).distinct()


def shared_ingredients(drugs: DataFrame, current: DataFrame) -> DataFrame:
    """drug, medication, shared: queried and current drugs with an ingredient in common."""
    a = drugs.select("drug", F.explode("ingredients").alias("i"))
    b = current.select(F.col("drug").alias("medication"), F.explode("ingredients").alias("i"))
    return a.join(b, "i").where(F.lower("drug") != F.lower("medication")).groupBy("drug", "medication").agg(F.array_join(F.array_sort(F.collect_set("i")), ", ").alias("shared"))


def shared_classes(drugs: DataFrame, current: DataFrame) -> DataFrame:
    """drug, medication, class: one class in common and no ingredient; combination classes do not count."""
    useful = ~F.rlike("c", F.lit(r"(?i)\bcombinations?\b|\band\b"))
    a = drugs.select("drug", F.explode("classes").alias("c")).where(useful)
    b = current.select(F.col("drug").alias("medication"), F.explode("classes").alias("c")).where(useful)
    pairs = a.join(b, "c").where(F.lower("drug") != F.lower("medication")).groupBy("drug", "medication").agg(F.min("c").alias("class"))
    return pairs.join(shared_ingredients(drugs, current), ["drug", "medication"], "left_anti")


def resolved(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept of each distinct trimmed name, by a known id first (blanks are none), else by name; without ingredients a drug is its own."""
    asked = names.select(F.trim("name").alias("name"), F.nullif(F.trim("rxcui"), F.lit("")).alias("rxcui")).where("name <> ''").groupBy("name").agg(F.max("rxcui").alias("rxcui"))
    by_name = concepts.select(F.lower("name").alias("_n"), F.col("rxcui").alias("_r"))
    known = asked.join(by_name, F.lower("name") == F.col("_n"), "left").withColumn("rxcui", F.coalesce("rxcui", "_r")).drop("_n", "_r")
    facts = concepts.groupBy("rxcui").agg(F.first("ingredients").alias("ingredients"), F.first("classes").alias("classes"))
    out = known.join(facts, "rxcui", "left")
    own = F.when(F.coalesce(F.size("ingredients"), F.lit(0)) > 0, F.col("ingredients")).when(F.col("rxcui").isNotNull(), F.array(F.lower("name")))
    return out.select("name", "rxcui", F.coalesce(own, F.array().cast("array<string>")).alias("ingredients"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def missed(entities: DataFrame, mentioned: DataFrame, least_score: float = 0.6) -> DataFrame:
    """Entities of a document that its record does not mention: containment either way between cleaned names.

    entities: (doc, type, text, score); mentioned: (doc, type, name). The join is on document and type; containment is tested inside.
    """
    clean = lambda c: F.lower(scalars.drug_name(c))
    e = entities.where((F.col("score") >= least_score) & ~F.col("type").isin("dosage", "frequency")).withColumn("_n", clean(F.col("text"))).where(F.length("_n") >= 3)
    m = mentioned.select("doc", "type", clean(F.col("name")).alias("_m")).where("_m <> ''").groupBy("doc", "type").agg(F.collect_set("_m").alias("_ms"))
    both = e.join(m, ["doc", "type"], "left")
    said = F.exists("_ms", lambda x: F.contains(x, F.col("_n")) | F.contains(F.col("_n"), x))
    return both.where(~F.coalesce(said, F.lit(False))).drop("_n", "_ms")


def digest_priority(findings: DataFrame, keys: list[str], level: str, given: str | None = None) -> DataFrame:
    """urgent if any finding calls for action, elevated if any for attention, else normal; a given value wins."""
    rolled = F.when(F.bool_or(F.col(level) == "action_needed"), "urgent").when(F.bool_or(F.col(level) == "attention"), "elevated").otherwise("normal")
    return findings.groupBy(*keys).agg((F.coalesce(F.max(given), rolled) if given else rolled).alias("priority"))


def class_map(classes: DataFrame, id_col: str, name_col: str, ordinal: str) -> DataFrame:
    """One name for each class id: the last one listed."""
    return classes.groupBy(id_col).agg(F.max_by(name_col, ordinal).alias(name_col))


def explanation(status: Column, term: Column) -> Column:
    """What a mention's status means, in a sentence."""
    say = {
        "absent": "The document says that %s is not present.",
        "family": "%s is mentioned for a relative.",
        "historical": "%s is mentioned as something of the past.",
        "hypothetical": "%s is mentioned as something that might happen.",
        "uncertain": "%s is mentioned as a possibility.",
    }
    out = F.lit(None).cast("string")
    for k, v in say.items():
        out = F.when(status == k, F.format_string(v, term)).otherwise(out)
    return out


def audit_rows(checks: DataFrame, findings: DataFrame, key: str, severity: str) -> DataFrame:
    """One row to append for every check, also one without findings: their number and highest severity (info if there are none)."""
    top = highest_severity(findings, [key], severity).join(findings.groupBy(key).agg(F.count("*").alias("findings")), key)
    return checks.join(top, key, "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "severity": F.coalesce("severity", F.lit("info"))})
