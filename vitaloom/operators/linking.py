"""Dictionary linking: catalogues are DataFrames, so they grow without a change here.

Analytes: (key, display, loinc, canonical_unit, factors map<string,double>, synonyms array<string>, ordinal).
Conditions: (code, canonical, aliases array<string>, ordinal). Catalogues are small tables; Spark broadcasts them by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars

#: Words round a condition's name that do not belong to it.
_QUALIFIERS = (
    r"(?<![A-Za-z0-9_])(?:known case of|known|k/c/o|diagnosed(?: with)?|history of|h/o|c/o|complains? of|suspected|probable|possible|uncontrolled|controlled|poorly controlled"
    r"|newly diagnosed|old|longstanding|mild|moderate|severe|stage \w+|grade \w+|left|right|bilateral|primary|secondary|essential)(?![A-Za-z0-9_])"
)


def condition_name(c: Column) -> Column:
    """Comparable name: qualifiers out before and after punctuation, Roman numerals as digits."""
    s = F.regexp_replace(F.lower(scalars.urdu_normal(c)), _QUALIFIERS, " ")
    s = F.regexp_replace(F.regexp_replace(s, r"[(),.;:'\"\[\]{}]", " "), "[-–—/]", " ")
    s = scalars.squeeze(F.regexp_replace(s, _QUALIFIERS, " "))
    roman = F.create_map(*[F.lit(x) for kv in {"i": "1", "ii": "2", "iii": "3", "iv": "4"}.items() for x in kv])
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.try_element_at(roman, w), w)), " ")


def synonym_index(analytes: DataFrame) -> DataFrame:
    """(name, key): comparable synonyms; the later catalogue row owns a name that two share."""
    names = analytes.select("key", "ordinal", F.explode(F.concat("synonyms", F.array("display"))).alias("s")).select("key", "ordinal", scalars.test_name(F.col("s")).alias("name"))
    return names.where("name <> ''").groupBy("name").agg(F.max_by("key", "ordinal").alias("key"), F.max("ordinal").alias("ordinal"))


def link_analytes(labs: DataFrame, analytes: DataFrame, name_col: str) -> DataFrame:
    """Add ``key``: the analyte of a test name, exact first, then the longest synonym of 3 or more letters that stands in the
    name on word borders and covers 60 % of it. Only distinct names are linked, so repeated names cost one look-up."""
    index = synonym_index(analytes)
    names = labs.select(F.col(name_col).alias("_raw")).distinct().withColumn("_name", scalars.test_name(F.col("_raw")))
    exact = names.join(index.select(F.col("name").alias("_name"), "key"), "_name", "left")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    # candidates share a whole word with the name, so an equi-join on words comes before the substring test
    open_ = exact.where("key IS NULL").select("_raw", "_name", F.explode(F.array_distinct(F.split("_name", " "))).alias("_w"))
    parts = index.where(F.length("name") >= 3).select("name", F.col("key").alias("_k"), "ordinal", F.element_at(F.split("name", " "), 1).alias("_w"))
    near = open_.join(parts, "_w").where(F.contains(padded(F.col("_name")), padded(F.col("name"))) & (F.length("name") >= 0.6 * F.length("_name")))
    best = near.groupBy("_raw").agg(F.max_by("_k", F.struct(F.length("name"), -F.col("ordinal"))).alias("_k"))
    linked = exact.join(best, "_raw", "left").select("_raw", F.coalesce("key", "_k").alias("key"))
    return labs.join(linked, F.col(name_col) == F.col("_raw"), "left").drop("_raw")


def canonical_labs(labs: DataFrame, analytes: DataFrame, name_col: str, value_col: str, unit_col: str) -> DataFrame:
    """Linked rows with display name, loinc, canonical value and unit; unlinked rows keep their own name and no canonical value."""
    linked = link_analytes(labs, analytes, name_col).join(analytes.select("key", "display", "loinc", "canonical_unit", "factors"), "key", "left")
    value = F.when(F.col("key").isNotNull(), scalars.converted(F.col(value_col), F.col(unit_col), F.col("canonical_unit"), F.col("factors")))
    return linked.withColumns({"display": F.coalesce("display", name_col), "canonical_value": value}).drop("factors")


def link_conditions(df: DataFrame, conditions: DataFrame, raw_col: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Add code, canonical, matched_on, confidence: exact (1 / 0.95), a condition or symptom of the lexicon in any of its spellings (0.85), token
    subset (0.95 / 0.6); first hit wins."""
    names = df.select(F.col(raw_col).alias("_raw")).distinct().withColumn("_name", condition_name(F.col("_raw")))
    entries = conditions.select("code", "canonical", "ordinal", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("_p", "_e")).withColumn("_name", condition_name(F.col("_e")))
    index = entries.where("_name <> ''").groupBy("_name").agg(F.min_by(F.struct("code", "canonical", (F.col("_p") == 0).alias("head")), F.struct((F.col("_p") > 0), "ordinal", "_p")).alias("hit"))
    exact = names.join(index, "_name", "left").withColumn("link", F.when(F.col("hit").isNotNull(), F.struct(F.col("hit.code"), F.col("hit.canonical"), F.when(F.col("hit.head"), "exact").otherwise("alias").alias("matched_on"), F.when(F.col("hit.head"), 1.0).otherwise(0.95).alias("confidence"))))
    out = exact.select("_raw", "_name", F.col("link").alias("_exact"))
    if lexicon is not None:
        said = local_terms(names.where("_name <> ''").select("_raw"), lexicon, "_raw").where(F.col("kind").isin(*fixed.CONDITION_KINDS))
        by_local = said.select("_raw", condition_name(F.col("english")).alias("_en")).join(index.select(F.col("_name").alias("_en"), F.col("hit").alias("_lh")), "_en").select("_raw", "_lh")
        local = F.struct(F.col("_lh.code"), F.col("_lh.canonical"), F.lit("local-language").alias("matched_on"), F.lit(0.85).alias("confidence"))
        out = out.join(by_local, "_raw", "left").withColumn("_local", F.when(F.col("_lh").isNotNull(), local)).drop("_lh")
    else:
        out = out.withColumn("_local", F.lit(None).cast("struct<code:string,canonical:string,matched_on:string,confidence:double>"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    parts = entries.where("_name <> ''").select("code", "canonical", "ordinal", F.col("_name").alias("_alias"), words(F.col("_name")).alias("_ws")).where((F.size("_ws") >= 2) | (F.length("_alias") >= 4))
    parts = parts.select("*", F.col("_ws")[0].alias("_w"))
    open_ = out.where("_exact IS NULL AND _local IS NULL").select("_raw", "_name", words(F.col("_name")).alias("_toks")).where(F.size("_toks") <= 10)
    near = open_.withColumn("_w", F.explode("_toks")).join(parts, "_w").where(F.size(F.array_except("_ws", "_toks")) == 0)
    whole = F.size("_ws") == F.size("_toks")
    best = near.groupBy("_raw").agg(
        F.min_by(F.struct("code", "canonical", F.when(whole, "alias").otherwise("partial").alias("matched_on"), F.when(whole, 0.95).otherwise(0.6).alias("confidence")), F.struct(-F.size("_ws"), "ordinal", "_alias")).alias("_near")
    )
    linked = out.join(best, "_raw", "left").withColumn("_l", F.coalesce("_exact", "_local", "_near")).select("_raw", "_l.*")
    return df.join(linked, F.col(raw_col) == F.col("_raw"), "left").drop("_raw")


def suggested_code(confidence: Column, code: Column) -> Column:
    """A code is only suggested from 0.85 on."""
    return F.when(confidence >= 0.85, code)


def spelling_index(lexicon: DataFrame) -> DataFrame:
    """key, english, kind, ordinal of every spelling: ``u:`` folded script, ``l:`` the romanised word itself, ``p:`` its sound where that has 3 letters; the
    first entry of a key counts. lexicon: (english, kind, urdu array<string>, roman array<string>, ordinal)."""
    terms = ["english", "kind", "ordinal"]
    script = lexicon.select(*terms, F.explode("urdu").alias("w")).select(*terms, F.concat(F.lit("u:"), scalars.urdu_normal(F.col("w"))).alias("key"))
    roman = lexicon.select(*terms, F.explode("roman").alias("w"))
    literal = roman.select(*terms, F.concat(F.lit("l:"), scalars.squeeze(F.lower("w"))).alias("key"))
    sound = scalars.phrase_key(F.col("w"))
    heard = roman.where(F.length(F.replace(sound, F.lit(" "), F.lit(""))) >= fixed.LEAST_SOUND).select(*terms, F.concat(F.lit("p:"), sound).alias("key"))
    index = script.union(literal).union(heard).where(F.length("key") > 2)
    return index.groupBy("key").agg(F.min_by(F.struct("english", "kind", "ordinal"), "ordinal").alias("t")).select("key", "t.*")


def local_terms(df: DataFrame, lexicon: DataFrame, phrase_col: str) -> DataFrame:
    """Add ``english`` and ``kind`` of a phrase: one with a letter of the script by its folded script alone, else by the word itself, else by its sound."""
    index = spelling_index(lexicon)
    phrase = F.col(phrase_col)
    first = F.when(scalars.has_urdu(phrase), F.concat(F.lit("u:"), scalars.urdu_normal(phrase))).otherwise(F.concat(F.lit("l:"), scalars.squeeze(F.lower(phrase))))
    second = F.when(~scalars.has_urdu(phrase), F.concat(F.lit("p:"), scalars.phrase_key(phrase)))
    names = df.select(phrase_col).distinct().select(phrase.alias("_p"), first.alias("_1"), second.alias("_2"))
    by = lambda key, to: index.select(F.col("key").alias(key), F.struct("english", "kind").alias(to))
    found = names.join(by("_1", "_a"), "_1", "left").join(by("_2", "_b"), "_2", "left").select("_p", F.coalesce("_a", "_b").alias("_t"))
    return df.join(found, F.col(phrase_col) == F.col("_p"), "left").withColumns({"english": F.col("_t.english"), "kind": F.col("_t.kind")}).drop("_p", "_t")


def drug_matches(names: DataFrame, candidates: DataFrame, name_col: str) -> DataFrame:
    """Best candidate of a drug name: score and edit distance within bounds, first-ranked concept, its canonical spelling preferred.

    candidates: (query, rxcui, name, score, rank, source).
    """
    queries = names.withColumn("query", scalars.drug_name(F.col(name_col)))
    both = queries.join(candidates, "query", "left")
    far = F.levenshtein(F.lower("query"), F.lower("name")) / F.greatest(F.length("query"), F.length("name"), F.lit(1))
    ok = (F.col("score") >= fixed.EDIT_SCORE) & (far <= fixed.EDIT_SHARE)
    w = Window.partitionBy(name_col)
    locked = both.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_id", F.min_by("rxcui", F.when(F.col("_ok"), F.col("rank"))).over(w))
    pick = locked.where("_ok AND rxcui = _id").groupBy(name_col).agg(F.min_by(F.struct("rxcui", "name"), F.struct(F.when(F.col("source") == "RXNORM", 0).otherwise(1), "rank")).alias("hit"))
    out = queries.join(pick, name_col, "left")
    return out.select(name_col, F.coalesce("hit.name", "query").alias("name"), F.col("hit.rxcui").alias("rxcui"), F.coalesce(F.lower("hit.name") != F.lower("query"), F.lit(False)).alias("corrected"))
