"""Tolerant reading of extracted JSON, explosion into entity tables, and changes to tables as next versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.functions import fixed, scalars

#: Entity arrays of an extraction and their text fields.
ENTITIES = {
    "medications": ("name", "genericName", "dosage", "frequency", "duration", "route", "rxnormId", "isActive", "prescribedDate"),
    "diagnoses": ("condition", "icd10Code", "severity", "notes", "diagnosedDate", "assertionStatus"),
    "labResults": ("testName", "value", "numericValue", "unit", "referenceRange", "isAbnormal", "testDate"),
    "allergies": ("allergen", "allergyType", "severity", "reaction", "assertionStatus"),
}
FLAGS, NUMBERS, STATUSES = {"isActive", "isAbnormal"}, {"numericValue"}, {"assertionStatus"}


def lenient_json(c: Column) -> Column:
    """Variant of a text, or of what lies between its first and last brace; null if neither is JSON."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(inner))


def extraction(c: Column) -> Column:
    """Typed extraction of a JSON text: every field on its own, nothing fails the row. A status that is none of the known ones fails the schema, so that the
    whole extraction is empty, as one of another shape is."""
    raw = lenient_json(c)
    v = F.when(~_unknown_status(raw), raw)

    def items(name: str) -> Column:
        raw = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

        def one(x: Column) -> Column:
            fields = []
            for f in ENTITIES[name]:
                t = F.try_variant_get(x, f"$.{f}", "string")
                t = scalars.optional_flag(t) if f in FLAGS else scalars.optional_number(t) if f in NUMBERS else scalars.optional_text(t)
                fields.append(t.alias(f))
            return F.struct(*fields)

        objects = F.filter(raw, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
        return F.transform(objects, one)

    language = F.lower(F.trim(F.try_variant_get(v, "$.language", "string")))
    return F.struct(
        *[items(n).alias(n) for n in ENTITIES],
        *[scalars.optional_text(F.try_variant_get(v, f"$.{f}", "string")).alias(f) for f in ("hospital", "doctorName", "documentDate", "documentType")],
        F.when(language.isin("en", "ur", "mixed"), language).alias("language"),
    )


def _unknown_status(v: Column) -> Column:
    """Whether a finding or allergy has a status other than the known ones; none and null are no status."""
    out = F.lit(False)
    for name in (n for n, fields in ENTITIES.items() if STATUSES & set(fields)):
        items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        status = lambda x: F.try_variant_get(x, "$.assertionStatus", "variant")
        given = lambda x: F.coalesce(F.schema_of_variant(status(x)) != "VOID", F.lit(False))
        known = lambda x: F.coalesce(F.try_variant_get(x, "$.assertionStatus", "string").isin(*fixed.STATUSES), F.lit(False))
        out |= F.exists(items, lambda x: given(x) & ~known(x))  # noqa: B023
    return out


def is_empty(e: Column) -> Column:
    out = F.lit(True)
    for n in ENTITIES:
        out &= F.size(e[n]) == 0
    return out


def entity_rows(df: DataFrame, extraction_col: str, name: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(F.col(extraction_col)[name]))


def review_status(blank: Column, failed: Column, confidence: Column, empty: Column) -> Column:
    """failed: null, 'permanent' or another kind of failure."""
    return F.when(failed == "permanent", "failed").when(failed.isNotNull(), "pending").when(blank | empty | (confidence < 45), "needs_review").otherwise("confirmed")


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Target with those rows whose key it lacks; of equal new keys one stays."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti").select(*target.columns))


def replaced(target: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """Target with all rows of the owners in ``rows`` replaced by them."""
    return target.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def patched(target: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Listed columns overwritten where the patch has a value, and by null where its column ``<name>_set`` says that null is meant."""
    if not columns:
        raise ValueError("an empty patch changes nothing")
    meant = {c: f"{c}_set" in patch.columns for c in columns}
    p = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"{c}_set").alias(f"_set_{c}") for c in columns if meant[c]])
    new = lambda c: F.when(F.col(f"_set_{c}"), F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c)) if meant[c] else F.coalesce(f"_{c}", c)
    return target.join(p, key, "left").select(*[new(c).alias(c) if c in columns else F.col(c) for c in target.columns])


def cascade(children: DataFrame, gone: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children without those of deleted parents, or with the reference taken out."""
    if not set_null:
        return children.join(gone.select(key).distinct(), key, "left_anti")
    marked = children.join(gone.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return marked.withColumn(key, F.when(F.col("_k").isNull(), F.col(key))).drop("_k")


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a version folder, then name it in the next pointer file, put in place by a rename: readers see the old version or the new one, never
    half of either and never none, whatever step breaks."""
    spark = df.sparkSession
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    fs, Path = _files(spark, root)
    staged, target = Path(f"{root}/_pointers/.{uuid.uuid4().hex}"), Path(f"{root}/_pointers/{_pointer(fs, Path, root)[0] + 1:012d}")
    out = fs.create(staged, False)
    try:
        out.write(version.encode())
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        raise OSError("another version was published meanwhile")
    return path


def _files(spark: SparkSession, root: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def _pointer(fs, Path, root: str) -> tuple[int, object]:
    """Number and path of the newest pointer; 0 where none is."""
    folder = Path(f"{root}/_pointers")
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return max(((int(s.getPath().getName()), s.getPath()) for s in found if not s.getPath().getName().startswith(".")), key=lambda x: x[0], default=(0, None))


def current(spark: SparkSession, root: str) -> DataFrame:
    fs, Path = _files(spark, root)
    _, path = _pointer(fs, Path, root)
    stream = fs.open(path)
    try:
        version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(f"{root}/v={version}")


def with_defaults(wanted: DataFrame, stored: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Settings of every key: what is stored, else the default."""
    out = wanted.join(stored, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def revoked(links: DataFrame, token: str, owner_col: str, owner: object) -> DataFrame:
    """Links with the owner's one switched off; someone else's stays as it is."""
    return links.withColumn("is_active", F.when((F.col("token") == token) & (F.col(owner_col) == F.lit(owner)), False).otherwise(F.col("is_active")))


def inserted(rows: DataFrame, defaults: dict[str, object], path: str | None = None, job: str | None = None) -> DataFrame:
    """Rows as stored, with defaults where a column is missing or null; appended to the table at ``path`` if there is one.

    Rows of a ``job`` go to a part of the table that is the job's own, so that a job which runs again replaces what it wrote before and doubles nothing.
    """
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})
    if path is not None and job is not None:
        filled.write.mode("overwrite").parquet(f"{path}/job={job}")
    elif path is not None:
        filled.write.mode("append").parquet(path)
    return filled


def stored_list(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def loaded_list(c: Column) -> Column:
    """The list of a JSON column; anything that is no list of texts reads as empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _said(v: Column, path: str, low: int, high: int) -> Column:
    """Trimmed text at a path; null where it is no text or its length is out of bounds."""
    at = F.try_variant_get(v, path, "variant")
    t = F.trim(F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string")))
    return F.when(F.length(t).between(low, high), t)


def _one_of(v: Column, path: str, *values: str) -> Column:
    t = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.when(t.isin(*values), t)


def digest(raw: Column) -> Column:
    """A digest of JSON text, field by field: what does not fit takes its default, so one bad field loses nothing else.

    Findings are kept only if they are a list of at most 50, each with a title.
    """
    v = F.try_parse_json(raw)

    def finding(x: Column) -> Column:
        return F.struct(
            F.coalesce(_one_of(x, "$.category", "medications", "labs", "diagnoses", "allergies", "general"), F.lit("general")).alias("category"),
            _said(x, "$.title", 1, 300).alias("title"),
            F.coalesce(_said(x, "$.detail", 0, 4000), F.lit("")).alias("detail"),
            F.coalesce(_one_of(x, "$.priority", "info", "attention", "action_needed"), F.lit("info")).alias("priority"),
        )

    found = F.transform(F.try_variant_get(v, "$.findings", "array<variant>"), finding)
    sound = (F.size(found) <= 50) & ~F.exists(found, lambda f: f["title"].isNull())
    return F.struct(
        F.coalesce(_said(v, "$.title", 1, 500), F.lit("Health insight digest")).alias("title"),
        F.coalesce(_said(v, "$.digest", 1, 20_000), F.lit("No summary generated.")).alias("digest"),
        F.coalesce(F.when(sound, found), F.array().cast("array<struct<category:string,title:string,detail:string,priority:string>>")).alias("findings"),
        _one_of(v, "$.priority", "normal", "elevated", "urgent").alias("priority"),
    )


def _sayings(v: Column, path: str, longest: int, most: int) -> Column:
    """A list of at most ``most`` trimmed texts of 1 to ``longest`` characters; one that does not fit empties the whole list."""
    items = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: _said(x, "$", 1, longest))
    return F.coalesce(F.when((F.size(items) <= most) & ~F.exists(items, F.isnull), items), F.array().cast("array<string>"))


#: What a document can be.
DOCUMENT_TYPES = ("prescription", "lab_report", "discharge_summary", "imaging_report", "consultation_note", "voice_entry", "other")


def _optional(x: Column, path: str, longest: int) -> tuple[Column, Column]:
    """(trimmed text of at most ``longest`` characters, whether it is that or missing); null is neither."""
    at = F.try_variant_get(x, path, "variant")
    text = _said(x, path, 0, longest)
    return text, at.isNull() | text.isNotNull()


def voice_entry(raw: Column) -> Column:
    """What was dictated, as JSON, field by field: what does not fit takes its default, and one medication that does not fit empties the list of them. Null
    where the text is no JSON object."""
    v = F.try_parse_json(raw)

    def medication(x: Column) -> Column:
        (dosage, a), (frequency, b) = _optional(x, "$.dosage", 100), _optional(x, "$.frequency", 100)
        return F.struct(_said(x, "$.name", 1, 200).alias("name"), dosage.alias("dosage"), frequency.alias("frequency"), (a & b).alias("sound"))

    meds = F.transform(F.try_variant_get(v, "$.medications", "array<variant>"), medication)
    sound = (F.size(meds) <= 50) & ~F.exists(meds, lambda m: m["name"].isNull() | ~m["sound"])
    kept = F.transform(F.when(sound, meds), lambda m: F.struct(m["name"].alias("name"), m["dosage"].alias("dosage"), m["frequency"].alias("frequency")))
    entry = F.struct(
        F.coalesce(_one_of(v, "$.documentType", *DOCUMENT_TYPES), F.lit("voice_entry")).alias("documentType"),
        F.coalesce(_said(v, "$.title", 1, 200), F.lit("Voice note")).alias("title"),
        F.coalesce(_said(v, "$.description", 0, 4000), F.lit("")).alias("description"),
        F.coalesce(kept, F.array().cast("array<struct<name:string,dosage:string,frequency:string>>")).alias("medications"),
        _sayings(v, "$.symptoms", 200, 50).alias("symptoms"),
        _said(v, "$.date", 0, 50).alias("date"),
        _said(v, "$.doctorName", 0, 200).alias("doctorName"),
        _said(v, "$.hospital", 0, 200).alias("hospital"),
        _sayings(v, "$.conditions", 200, 50).alias("conditions"),
    )
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), entry)


def asked_entities(raw: Column) -> Column:
    """Drugs, foods and supplements that a question names, as JSON; each list on its own, and all empty where the text is no JSON object."""
    v = F.try_parse_json(raw)
    return F.struct(*(_sayings(v, f"$.{n}", 200, 30).alias(n) for n in ("drugs", "foods", "supplements")))
