"""Small inline tables, as a DataFrame and as SQL of the same rows, and dealt over a given table: each of its rows takes the part of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.sources.tables import scan


class Rows:
    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split(" ")[0] for c in schema.split(",")]
        self.kinds = [c.strip().split(" ")[1] for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    def _dealt(self, key: str) -> Rows:
        """The rows with the place of their key in order of appearance, in place of the key."""
        at = self.names.index(key)
        places = {k: i for i, k in enumerate(dict.fromkeys(r[at] for r in self.rows))}
        schema = ", ".join(f"{'k_' if n == key else n} {'int' if n == key else t}" for n, t in zip(self.names, self.kinds, strict=True))
        return Rows(schema, *[tuple(places[v] if i == at else v for i, v in enumerate(r)) for r in self.rows])

    def keys(self, key: str | None = None) -> int:
        at = self.names.index(key or self.names[0])
        return len({r[at] for r in self.rows})

    def over(self, spark: SparkSession, sf_dir: str, key: str | None = None, table: str = "documents", id_col: str = "doc_id") -> DataFrame:
        """The rows with ids of ``table`` as key: every id takes the part of one key, with all rows of it."""
        key = key or self.names[0]
        ids = scan(spark, sf_dir, table, F.col(id_col).alias(key)).withColumn("k_", F.pmod(key, F.lit(self.keys(key))).cast("int"))
        return ids.join(self._dealt(key).df(spark), "k_").select(*self.names)

    def over_sql(self, key: str | None = None, table: str = "documents", id_col: str = "doc_id") -> str:
        key = key or self.names[0]
        columns = ", ".join(f"t.{id_col} AS {n}" if n == key else f"f.{n}" for n in self.names)
        return f"(SELECT {columns} FROM {table} t JOIN {self._dealt(key).sql} ON t.{id_col} % {self.keys(key)} = f.k_) AS f"

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}

        def one(v: object, kind: str) -> str:
            if v is None:
                return f"NULL::{kinds[kind]}"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return f"{str(v).lower() if isinstance(v, bool) else v!r}::{kinds[kind]}"

        rows = ", ".join("(" + ", ".join(one(v, k) for v, k in zip(r, self.kinds, strict=True)) + ")" for r in self.rows)
        return f"(VALUES {rows}) AS f({', '.join(self.names)})"


VALUES = Rows("id int, raw string", *enumerate(["1,50,000", "1,500,000", "<5.7", "> 200", "≤ 40", ">=40", "7.4 %", "88.4 umol/L", "-2.5", "۸.۲", "Negative", "", None, "+3.5 mg", "abc 12", "٣٤"]))
RANGES = Rows("id int, raw string", *enumerate(["4.0-5.6", "4.0 – 5.6", "4.0 to 5.6", "5.6-4.0", "up to 4.2", "< 200", "≤ 150", "less than 100", "> 40", "above 60", "at least 12", "Negative", "Non-reactive.", "see comment", "", None, "70/110", "1,000-2,000"]))
FLAGS = Rows("id int, value double, raw string", (0, 8.2, "up to 4.2"), (1, 5.6, "4.0-5.6"), (2, 5.0, "see comment"), (3, 3.9, "4.0-5.6"), (4, None, "4-5"), (5, 40.0, "> 40"), (6, 39.0, "> 40"), (7, 1.0, "Negative"))
NAMES = Rows("id int, raw string", *enumerate(["HbA1c", "Hb A1c", "Serum Creatinine (fasting)", "Blood Urea Level", "S. Potassium", "Potassium Hydroxide Prep", "Total Cholesterol/HDL", "  TSH  level ", "Glycated Haemoglobin"]))
DRUGS = Rows("id int, raw string", *enumerate(["Tab. Metformin 850mg BD", "Amlodipin[unclear: e] 5mg", "Inj. Ceftriaxone 1 g IV stat", "Syp Paracetamol 120 mg/5ml tds", "Cap Omeprazole-DSR 20mg od", "Co-amoxiclav", "Vitamin D3 60,000 IU"]))
SCRIPTS = Rows("id int, raw string", *enumerate(["hello world", "شوگر کی بیماری", "sugar شوگر test", "12345", "", "BP high ہے mareez ko bukhar tha"]))
ROMAN = Rows("id int, raw string", *enumerate(["khansi", "khaansi", "khansee", "bukhar", "bukhaar", "qabz", "wazan", "Phephray", "ziabetes", "x", "aankh", ""]))
UNITS = Rows("id int, value double, unit string, canonical string, factor double", (0, 88.4, "umol/l", "mg/dL", 0.011312217194570135), (1, 5.5, "mmol/l", "mg/dL", 18.0182), (2, 7.2, None, "%", None), (3, 5.0, "furlongs", "mg/dL", None), (4, 2.4, "x", None, None), (5, 14.0, "G/DL", "g/dL", None), (6, 3.0, " ", "g/dL", None))
SEVERITY = Rows("grp int, severity string", (1, "mild"), (1, "severe"), (1, "moderate"), (2, None), (3, "info"), (3, None), (4, "contraindicated"), (4, "severe"), (5, "mild"))
FAILURES = Rows("id int, status int, code string, message string, header string", (0, 429, None, "slow down", None), (1, None, None, "Rate limit reached, please try again in 6m29.664s", None), (2, 429, None, "x", "30"), (3, 503, None, "unavailable", None), (4, 400, None, "bad request", None), (5, None, "ECONNRESET", "reset", None), (6, None, None, "fetch failed", None), (7, None, None, "quota exceeded; try again in 12.2s", "-1"))
PAGES = Rows("doc int, page int, text string, confidence double, handwritten boolean", (1, 1, "alpha ", 90.0, True), (1, 2, "  ", 10.0, True), (1, 3, "beta", 81.0, False), (2, 1, "", 50.0, False), (3, 1, "gamma", 70.0, True), (3, 2, "delta", 75.0, False))
ENTITIES = Rows(
    "doc long, place int, type string, text string, score double",
    *[(d, k, *r) for k, (d, *r) in enumerate([(1, "medication", "Metformin", 0.75), (1, "medication", "Penicillin", 0.9), (1, "medication", "Atorvastatin 20mg", 0.75), (1, "medication", "Xy", 0.9), (1, "medication", "Losartan", 0.4), (1, "condition", "asthma", 0.8), (1, "dosage", "850mg", 0.9), (2, "condition", "Diabetes", 0.8), (2, "condition", "diabetes", 0.95), (2, "condition", "Fever", 0.9), (2, "condition", "FEVER", 0.9), (2, "condition", "fever", 0.7)])],
)
MENTIONED = Rows("doc long, type string, name string", (1, "medication", "Tab Metformin 850mg"), (1, "medication", "Penicillin"), (1, "condition", "hypertension"), (2, "condition", "Type 2 diabetes mellitus"))
SEVERITIES_OF = Rows("allergen string, severity string", ("Penicillins", "severe"), ("Sulfa", "moderate"), ("Aspirin", None))
MEDICATIONS = Rows("id long, owner long, name string, is_active boolean, day string", (1, 1, "a", True, "2024-01-05"), (2, 1, "b", None, "2024-01-09"), (3, 1, "c", False, "2024-02-01"), (4, 1, "d", True, None), (5, 2, "e", True, "2024-03-01"), (6, 1, "f", None, None))
ALLERGIES = Rows("id long, owner long, allergen string, severity string", (1, 1, "dust", "mild"), (2, 1, "penicillin", "Severe"), (3, 1, "nuts", None), (4, 2, "latex", "severe"), (5, 1, "sulfa", "severe"))
EXTRACTIONS = Rows(
    "doc long, raw string",
    (1, '{"medications":[{"name":" Metformin ","isActive":"yes","dosage":"N/A"},null,"x",{"name":"none","isActive":0}],"labResults":[{"testName":"HbA1c","value":"7,200 mg","numericValue":"7,200 mg","isAbnormal":"HIGH"}],"hospital":"unknown","language":" EN "}'),
    (2, 'Here it is: {"diagnoses":[{"condition":"Asthma","assertionStatus":"present"}],"language":"fr"} done'),
    (3, "not json"),
    (4, None),
    (5, '{"medications":"oops","allergies":[]}'),
    (6, '{"medications":[{"name":"Metformin"}],"diagnoses":[{"condition":"Asthma","assertionStatus":"perhaps"}],"language":"en"}'),
)
