"""Secret scan: pattern candidates, and a random forest that takes false positives out.

Only DataFrame and SQL functions run, Spark ML's forest included. Candidates come from one regular expression; places
follow from the gaps between matches. Features of a candidate: length, character transitions, share of dictionary
words and syllables, path marks, and words beside it. The forest is fitted on labelled findings (:func:`labelled_findings`,
a fixed number of rows) and then written out as one SQL expression, so a text and its verdicts never leave their row:
no join, no shuffle, no model object in the tasks.

A candidate is always a whole run of key characters, of any length, so that nothing of a key is left beside its mark.
Never a candidate: runs of under 14 characters without a known prefix, runs without a digit, and what goes on after
another character than a letter, digit or ``_/+-=`` (as in ``hunter2secret!``, of which 13 characters are a run).

Defined results: null and empty texts have no findings; a text of any length is scanned whole; repeated rows have
the same findings each, also without id; extra columns pass through :func:`scan` and :func:`redact` whatever their names (one that is
called like ``out`` is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm.common import sums_before

#: What a candidate looks like. Group 1 is the candidate itself.
CANDIDATE = (
    r"(?<![A-Za-z0-9_/+.@-])"
    r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"
    r"|(?:(?:AKIA|ASIA)[A-Z0-9]{12}|gh[pousr]_[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9-]{10})[A-Za-z0-9_/+-]*+={0,2}"
    r"|(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{14,}+={0,2})"
)
#: Characters before and after a candidate that count as its neighbourhood.
BESIDE = 32
#: Words that announce a secret, and words that announce something else.
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer"
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|isbn|order|invoice|phone|card|example|version|build|hash|href|src"
#: Common words of file names, identifiers and prose, then syllables; their share of a candidate is its dictionary coverage.
DICTIONARY = (
    "version|release|package|project|example|default|service|request|response|message|content|context|control|program|process|function|"
    "document|directory|download|upload|image|index|table|model|class|object|string|number|value|index|public|static|private|module|"
    "report|article|chapter|section|archive|history|search|result|source|target|before|after|under|other|people|house|world|water|year|"
    "user|name|file|data|page|test|code|line|list|form|time|part|work|make|with|from|that|this|have|und|der|die|das|ein|les|des|una|los|para|"
    "tion|ing|the|and|ent|ion|ter|ver|ment|ich|sch|eit|que|eau|aux|oui|est|ado|con|able|ness"
)
FEATURES = ("length", "digits", "upper", "lower", "switches", "runs", "coverage", "slashes", "other_marks", "hex_only", "digits_only", "known_prefix", "secret_beside", "other_beside", "quoted", "assigned")
TREES, DEPTH, SEED = 15, 6, 11


class Forest(NamedTuple):
    """score: SQL over the names of ``FEATURES``; accuracy on the findings held out; model: Spark's own, which scores alike."""

    score: str
    accuracy: float
    model: object = None


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def features(token: Column, before: Column, after: Column) -> dict[str, Column]:
    size = F.greatest(F.length(token), F.lit(1)).cast("double")
    return {
        "length": size,
        "digits": _count(token, "[0-9]") / size,
        "upper": _count(token, "[A-Z]") / size,
        "lower": _count(token, "[a-z]") / size,
        "switches": (_count(token, "[a-z](?=[A-Z0-9])") + _count(token, "[A-Z](?=[a-z0-9])") + _count(token, "[0-9](?=[A-Za-z])")) / size,
        "runs": _count(token, r"(.)\1") / size,
        "coverage": (size - F.length(F.regexp_replace(F.lower(token), DICTIONARY, ""))) / size,
        "slashes": _count(token, "/"),
        "other_marks": _count(token, "[_+=-]") / size,
        "hex_only": F.rlike(token, F.lit("^[0-9a-f]+$")).cast("double"),
        "digits_only": F.rlike(token, F.lit("^[0-9-]+$")).cast("double"),
        "known_prefix": F.rlike(token, F.lit("^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ)")).cast("double"),
        "secret_beside": F.rlike(before, F.lit(f"(?i)({SECRET_WORDS})")).cast("double"),
        "other_beside": F.rlike(F.concat(before, F.lit(" "), after), F.lit(f"(?i)({OTHER_WORDS})")).cast("double"),
        "quoted": (F.rlike(before, F.lit("[\"']$")) & F.rlike(after, F.lit("^[\"']"))).cast("double"),
        "assigned": F.rlike(before, F.lit("[=:]\\s*[\"']?$")).cast("double"),
    }


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """token, before, after, label: ``rows`` findings of known kind, the same ones every time.

    Half are secrets of several makes with and without an announcing word; half are look-alikes: digests and ids in
    their usual surroundings, card numbers, paths, long words with digits, placeholders.
    """
    r = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"#{salt}")), 256)
    b64 = F.translate(F.base64(F.unhex(F.concat(r("a"), r("b")))), "=\n\r", "")
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    num = lambda salt, lo, hi: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("int")
    word = pick("w1", "therion", "stenver", "lichkeit", "quemente", "oreaux", "andthe", "formation", "ciónado", "anshing")
    word2 = pick("w2", "tioned", "schaft", "eauque", "mentado", "overing", "entheit", "blering", "ster")
    says = pick("s", "password=", "password: ", "secret = \"", "token = \"", "api_key=", "API_KEY: ", "access_key = '", "Authorization: Bearer ", "pwd=", "credential: ")
    plain = pick("p", "the and of ", "in einer und ", "es de la ", ", ", "est une ", ". ", "", "see ", "value ")
    make = F.pmod(F.col("id"), F.lit(12))
    upper = F.upper(F.translate(b64, "+/abcdef", "QZABCDEF"))
    token = (
        F.when(make == 0, F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(upper, "[^A-Z0-9]", "7"), 1, 16)))
        .when(make == 1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)))
        .when(make == 2, F.substring(r("h"), F.lit(1), num("n2", 16, 40)))
        .when(make == 3, F.substring(r("h"), F.lit(1), num("n3", 16, 48)))
        .when(make == 4, F.substring(b64, F.lit(1), num("n4", 20, 64)))
        .when(make == 5, F.concat(F.lit("xoxb-"), F.substring(F.regexp_replace(b64, "[+/]", "k"), 1, 40)))
        .when(make == 6, F.substring(r("c"), 1, 40))
        .when(make == 7, F.concat_ws("-", F.substring(r("u"), 1, 8), F.substring(r("u"), 9, 4), F.substring(r("u"), 13, 4), F.substring(r("u"), 17, 4), F.substring(r("u"), 21, 12)))
        .when(make == 8, F.substring(F.regexp_replace(F.conv(F.substring(r("d"), 1, 15), 16, 10).cast("string") + F.lit(0), "[^0-9]", "4"), 1, 16))
        .when(make == 9, F.concat_ws("/", word, word2, F.concat(F.lit("v"), num("n9", 1, 40).cast("string")), F.concat(word2, num("m9", 1, 4000).cast("string"))))
        .when(make == 10, F.concat(word, word2, pick("w3", "", "_", "-"), word2, num("n10", 1, 2030).cast("string")))
        .otherwise(F.concat(pick("x", "xxxxxxxxxxxx", "000000000000", "1234567890123", "YOUR_KEY_HERE_", "-------------", "==============", "AKIAEXAMPLEEXA"), num("n11", 1, 99).cast("string")))
    )
    digits = F.lpad(F.translate(F.substring(r("d"), 1, 16), "abcdef", "102938"), 16, "4")
    token = F.when(make == 8, digits).otherwise(token)
    before = (
        F.when(make.isin(0, 1, 5), F.when(F.pmod(F.xxhash64("id", F.lit("k")), F.lit(2)) == 0, says).otherwise(plain))
        .when(make.isin(2, 3, 4), says)
        .when(make == 6, pick("b6", "commit ", "sha1: ", "sha256:", "checksum = ", "digest: ", "build hash ", "md5 "))
        .when(make == 7, pick("b7", "uuid=", "id: ", "guid ", "request ", "order ", "the "))
        .when(make == 8, pick("b8", "the ", "card ", "phone ", "and of ", "der ", "que ", "", "invoice "))
        .when(make == 9, pick("b9", "see /", "href=\"", "src=\"", "in ", "file ", "from "))
        .when(make == 10, plain)
        .otherwise(F.when(F.pmod(F.xxhash64("id", F.lit("k")), F.lit(2)) == 0, says).otherwise(plain))
    )
    before = F.concat(plain, word, F.lit(" "), before)
    after = F.when(F.rlike(before, F.lit("\"$")), "\" and").when(F.rlike(before, F.lit("'$")), "' and").otherwise(F.concat(F.lit(" "), word2))
    return spark.range(rows).select("id", token.alias("token"), before.alias("before"), after.alias("after"), (make <= 5).cast("double").alias("label"))


def _tree_sql(node, names: tuple[str, ...]) -> str:
    """CASE expression of one tree: a leaf gives its share of secrets among the findings it was fitted on."""
    if node.getClass().getSimpleName() == "LeafNode":
        other, secret = node.impurityStats().stats()
        return repr(secret / (other + secret)) + "D"
    split = node.split()
    left, right = _tree_sql(node.leftChild(), names), _tree_sql(node.rightChild(), names)
    return f"CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r}D THEN {left} ELSE {right} END"


def described(findings: DataFrame) -> DataFrame:
    """Labelled findings with their features, also as the vector ``x``."""
    from pyspark.ml.feature import VectorAssembler

    data = findings.select("*", *[v.alias(k) for k, v in features(F.col("token"), F.col("before"), F.col("after")).items()])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(data)


def fit(spark: SparkSession, findings: DataFrame | None = None) -> Forest:
    """Fit on three quarters of the labelled findings; the rest measure it."""
    from pyspark.ml.classification import RandomForestClassifier

    findings = labelled_findings(spark) if findings is None else findings
    rows = described(findings.coalesce(2)).withColumn("_held", F.pmod(F.xxhash64("token", "before"), F.lit(4)) == 0)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows.where("NOT _held"))
    trees = [_tree_sql(t._java_obj.rootNode(), FEATURES) for t in model.trees]
    score = "(" + " + ".join(trees) + f") / {len(trees)}D"
    right = rows.where("_held").select(F.avg(((F.expr(score) > 0.5).cast("double") == F.col("label")).cast("double"))).first()[0]
    return Forest(score, float(right or 0.0), model)


def _found(df: DataFrame, forest: Forest, text_col: str) -> DataFrame:
    """row (all columns of ``df``), gaps (what lies between the candidates), found (the candidates)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.regexp_extract_all(text, F.lit(CANDIDATE), 1).alias("m"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    # gaps between matches, for those rows that have any
    df = df.withColumn("gaps", F.when(F.size("m") > 0, F.split(text, CANDIDATE)).otherwise(F.array(text)))
    df = df.withColumn("sizes", F.zip_with("gaps", "m", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
    df = df.withColumn("p", sums_before("sizes"))

    def described(z: Column) -> Column:
        f = features(z["token"], F.right(z["before"], F.lit(BESIDE)), F.left(z["after"], F.lit(BESIDE)))
        return F.struct((z["at"] + F.length(z["before"])).alias("start"), z["token"].alias("token"), *[f[k].alias(k) for k in FEATURES])

    # zipped first: a lambda that reaches into another column's array would have that array made anew for each candidate
    zipped = F.arrays_zip(F.col("m").alias("token"), F.col("p").alias("at"), F.col("gaps").alias("before"), F.slice("gaps", 2, F.size("gaps")).alias("after"))
    df = df.withColumn("f", F.transform(F.slice(zipped, F.lit(1), F.size("m")), described))
    score = re.sub(r"\b(" + "|".join(FEATURES) + r")\b", r"x.\1", forest.score)
    df = df.withColumn("s", F.expr(f"transform(f, x -> named_struct('start', x.start, 'length', length(x.token), 'token', x.token, 'score', round({score}, 6)))"))
    found = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["token"].alias("token"), x["score"].alias("score"), (x["score"] > 0.5).alias("secret")))
    return df.select("row", "gaps", found.alias("found"))


def scan(df: DataFrame, forest: Forest, text_col: str = "text", out: str = "findings") -> DataFrame:
    """``df`` with ``out``: array<struct<start, length, token, score, secret>> in order of place (code points from 0)."""
    return _found(df, forest, text_col).select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], F.col("found").alias(out))


def redact(df: DataFrame, forest: Forest, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every confirmed secret in the text replaced by ``mark``; null texts stay null."""
    shown = F.transform("found", lambda x: F.when(x["secret"], mark).otherwise(x["token"]))
    clean = F.array_join(F.flatten(F.zip_with("gaps", F.concat(shown, F.array(F.lit(""))), lambda g, t: F.array(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit(""))))), "")
    text = F.when(F.exists("found", lambda x: x["secret"]), clean).otherwise(F.col("row")[text_col])
    return _found(df, forest, text_col).select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
