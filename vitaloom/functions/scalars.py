"""Scalar functions as Column → Column. No Python runs in a row, but for :func:`composed`; ``as_of`` takes the place of a clock."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom.functions import fixed


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ascii_digits(c: Column) -> Column:
    """Eastern digits as 0-9."""
    return F.translate(c, *fixed.EASTERN_DIGITS)


def without_group_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d),(?=\d)", "$1")


def measured_value(c: Column) -> Column:
    """struct<value, censoring>: a leading comparison sign and the first number that no digit precedes; null without one."""
    s = F.trim(without_group_commas(ascii_digits(c)))
    sign = F.regexp_extract(s, r"^(<=|>=|≤|≥|<|>)", 1)
    number = F.regexp_extract(s, r"^[^\d+-]*([+-]?\d+(?:\.\d+)?)", 1)
    kind = F.when(sign == "<=", "≤").when(sign == ">=", "≥").when(sign != "", sign)
    return F.when(number != "", F.struct(number.try_cast("double").alias("value"), kind.alias("censoring")))


def reference_range(c: Column) -> Column:
    """struct<min, max, qualitative>: a word, two bounds in either order, an upper or a lower bound; else null."""
    s = F.trim(ascii_digits(c))
    word = F.regexp_replace(F.lower(s), r"[.\s]+$", "")
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.QUALITATIVE_RANGES.items() for x in kv]), word)
    n = r"(-?\d+(?:\.\d+)?)"
    t = without_group_commas(s)

    def pair(between: str) -> Column:
        p = f"(?i){n}\\s*{between}\\s*{n}"
        a, b = F.regexp_extract(t, p, 1).try_cast("double"), F.regexp_extract(t, p, 2).try_cast("double")
        return F.when(F.rlike(t, F.lit(p)), F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max"), F.lit(None).cast("string").alias("qualitative")))

    def bound(words: str, upper: bool) -> Column:
        p = f"(?i)(?:{words})\\s*{n}"
        v, none = F.regexp_extract(t, p, 1).try_cast("double"), F.lit(None).cast("double")
        return F.when(F.rlike(t, F.lit(p)), F.struct((none if upper else v).alias("min"), (v if upper else none).alias("max"), F.lit(None).cast("string").alias("qualitative")))

    word_only = F.when(named.isNotNull(), F.struct(F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), named.alias("qualitative")))
    return F.when(
        s != "",
        F.coalesce(
            word_only,
            pair("(?:to|[-–—])"),
            pair("/"),
            bound(r"<=?|≤|up\s*to|less\s+than|below|max(?:imum)?", True),
            bound(r">=?|≥|at\s*least|greater\s+than|more\s+than|above|min(?:imum)?", False),
        ),
    )


def out_of_range(value: Column, range_: Column) -> Column:
    """True, false, or null where it cannot be told; bounds belong to the range."""
    low, high = range_["min"], range_["max"]
    known = value.isNotNull() & (low.isNotNull() | high.isNotNull())
    return F.when(known, F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)))


def test_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"\(.*?\)", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}%^/]+", " ")
    s = F.regexp_replace(s, r"(?<![A-Za-z0-9_])(?:serum|plasma|blood|s|p|test|level|levels|conc|concentration)(?![A-Za-z0-9_])", " ")
    return squeeze(s)


def unit_name(c: Column) -> Column:
    s = F.regexp_replace(F.translate(F.lower(c), "µμ", "uu"), r"(?U)\s+", "")
    return F.regexp_replace(s, "^per", "/")


def converted(value: Column, unit: Column, canonical: Column, factors: Column) -> Column:
    """Value in the canonical unit; no unit means it already is; an unknown unit gives null; no canonical unit passes through."""
    name = unit_name(unit)
    factor = F.try_element_at(factors, name)
    return F.when(canonical.isNull() | unit.isNull() | (F.trim(unit) == ""), value).when(factor.isNotNull(), value * factor).when(name == unit_name(canonical), value)


def token_estimate(c: Column) -> Column:
    """At least 1: Arabic-script characters weigh 1 / 2.5, others 1 / 4; characters beyond the basic plane count twice."""
    size = F.length(c) + F.length(c) - F.length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", ""))
    arabic = F.length(c) - F.length(F.regexp_replace(c, fixed.ARABIC_TOKENS, ""))
    return F.greatest(F.lit(1), F.ceil(arabic / 2.5 + (size - arabic) / 4)).cast("int")


def recency(day: Column, as_of: Column, span_days: int = fixed.RECENCY_DAYS) -> Column:
    """0.5 unknown, 1 in the future, else falling to 0 over ``span_days``."""
    age = (as_of.cast("timestamp").cast("double") - day.cast("timestamp").cast("double")) / 86400
    return F.when(day.isNull(), 0.5).when(age < 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - age / span_days))


def section_score(section: Column, wanted: str | None) -> Column:
    return F.lit(0.5) if wanted is None else F.when(F.lower(section) == wanted.lower(), 1.0).otherwise(0.0)


def blended(rrf_share: Column, coverage: Column, recency_: Column, section: Column) -> Column:
    w = fixed.WEIGHTS
    return rrf_share * w["rrf"] + coverage * w["coverage"] + recency_ * w["recency"] + section * w["section"]


def term_weight(c: Column) -> Column:
    n = F.length(c)
    return F.when(F.rlike(c, F.lit("[0-9]")), 2.0).when(n >= 8, 1.5).when(n >= 5, 1.2).otherwise(1.0)


def clamped(c: Column, n: int) -> Column:
    return F.nullif(F.left(c, F.lit(n)), F.lit(""))


def confidence(c: Column, fallback: int) -> Column:
    return F.coalesce(F.least(F.lit(100), F.greatest(F.lit(0), F.round(c).cast("int"))), F.lit(fallback))


#: Characters that composition may change or join: marks, and those that decompose into something else.
_COMPOSES = r"[\p{M}\x{0340}-\x{0345}\x{0374}\x{037E}\x{0387}\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}\x{0B5C}\x{0B5D}\x{0F43}-\x{0FB9}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"


def composed(c: Column) -> Column:
    """Canonical composition. Only texts that hold a character which it could touch cross to Python, batch by batch."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.coalesce(run(F.when(F.rlike(c, F.lit(_COMPOSES)), c)), c)


def urdu_normal(c: Column) -> Column:
    """Comparable form: composed, no invisible marks or vowel signs, letters and digits folded, punctuation as blanks."""
    s = F.regexp_replace(composed(c), r"[​-‏‪-‮⁠-⁤﻿ـ]", "")
    s = F.regexp_replace(s, r"[ؐ-ًؚ-ٰٟۖ-ۭ]", "")
    s = ascii_digits(F.translate(s, *fixed.LETTER_FOLDING))
    return squeeze(F.regexp_replace(s, fixed.URDU_PUNCTUATION, " "))


def script(c: Column) -> Column:
    urdu = F.length(c) - F.length(F.regexp_replace(c, fixed.URDU_LETTERS, ""))
    latin = F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z]", ""))
    share = urdu / F.nullif(urdu + latin, F.lit(0))
    return F.when(share.isNull(), "unknown").when(share >= 1 - fixed.MIXED_SHARE, "urdu").when(share <= fixed.MIXED_SHARE, "latin").otherwise("mixed")


def _single(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1+", "$1")


def sound_key(word: Column) -> Column:
    """Spelling-proof key of a romanised word: digraphs folded, repeats squeezed, inner vowels dropped."""
    s = F.regexp_replace(F.lower(word), "[^a-z]", "")
    s = _single(reduce(lambda a, d: F.replace(a, F.lit(d[0]), F.lit(d[1])), fixed.DIGRAPHS, s))
    return _single(F.concat(F.left(s, F.lit(1)), F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiou]", "")))


def phrase_key(phrase: Column) -> Column:
    return F.array_join(F.array_remove(F.transform(F.split(F.trim(phrase), r"\s+"), sound_key), ""), " ")


def drug_name(c: Column) -> Column:
    """A drug's name without notes on reading, form, strength, times and symbols."""
    s = F.regexp_replace(c, r"(?i)\[unclear:[^\]]*\]", " ")
    for p in (fixed.DRUG_FORMS, fixed.DRUG_STRENGTHS, fixed.DRUG_TIMES):
        s = F.regexp_replace(s, "(?i)" + p, " ")
    return squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}\s-]", " "))


def plain_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def singular(c: Column) -> Column:
    return F.when((F.length(c) > 4) & F.endswith(c, F.lit("s")), F.left(c, F.length(c) - 1)).otherwise(c)


def content_terms(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")
    stops = F.array(*map(F.lit, fixed.STOPWORDS))
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def section_of(line: Column) -> Column:
    """Section that a line announces; General if none. Most lines announce none, which one pattern of all sections tells."""
    out = F.lit("General")
    for name, pattern in reversed(fixed.SECTIONS):
        out = F.when(F.rlike(line, F.lit("(?i)" + pattern)), name).otherwise(out)
    return F.when(F.rlike(line, F.lit("(?i)" + "|".join(p for _, p in fixed.SECTIONS))), out).otherwise("General")


def bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once a row however often ``f`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def optional_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*fixed.NULLISH), t)


def optional_number(c: Column) -> Column:
    """First number anywhere in the text, commas out."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def optional_flag(c: Column) -> Column:
    t = F.lower(F.trim(c))
    number = t.try_cast("double")
    return F.when(t.isin(*fixed.TRUE_WORDS), True).when(t.isin(*fixed.FALSE_WORDS), False).when(number.isNotNull(), number != 0)


def like_literal(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def safe_day(c: Column, this_year: int) -> Column:
    """Date of the listed formats, if its year is plausible."""
    d = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "dd MMM yyyy", "MMM d, yyyy", "yyyy/MM/dd")])
    return F.when(F.year(d).between(1900, this_year + 1), d)


def failure_kind(status: Column, code: Column, message: Column) -> Column:
    limited = (status == 429) | F.rlike(message, F.lit("(?i)rate.?limit|quota|too many requests"))
    passing = (status >= 500) | code.isin("ECONNRESET", "ETIMEDOUT") | F.rlike(message, F.lit("(?i)timeout|aborted|fetch failed|network|socket hang up|ECONNREFUSED"))
    return F.when(limited, "rate_limit").when(passing, "transient").otherwise("permanent")


def retry_seconds(header: Column, message: Column) -> Column:
    p = r"(?i)try again in\s+(?:(\d+)m)?([\d.]+)s"
    seconds = F.regexp_extract(message, p, 2).try_cast("double")
    waited = F.ceil(F.coalesce(F.regexp_extract(message, p, 1).try_cast("double"), F.lit(0.0)) * 60 + seconds).cast("double")
    given = header.try_cast("double")
    return F.coalesce(F.when(given >= 0, given), F.when(F.rlike(message, F.lit(p)), waited))


def cache_key(user: Column, fingerprint: Column, message: Column) -> Column:
    """Key of an answer: user, state of the record, and the question without case and spacing."""
    return F.sha2(F.concat_ws(":", user, fingerprint, squeeze(F.lower(message))), 256)


def has_urdu(c: Column) -> Column:
    return F.rlike(c, F.lit(fixed.URDU_LETTERS))


def has_words(c: Column) -> Column:
    """Something a word search can find: two letters or digits in a row."""
    return F.rlike(c, F.lit(r"[\p{L}\p{N}]{2,}"))


def abnormal(given: Column, value: Column, range_: Column) -> Column:
    """What the record says, else what its range says, else false."""
    return F.coalesce(given, out_of_range(value, range_), F.lit(False))


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def bounded_int(c: Column, low: int, high: int | None, default: int) -> Column:
    """struct(value, valid) of a parameter given as text: none means the default, no whole number or one out of bounds is not valid."""
    number = F.trim(c).try_cast("double")
    fits = (number == F.floor(number)) & (number >= low) & (F.lit(True) if high is None else number <= high)
    valid = c.isNull() | F.coalesce(fits, F.lit(False))
    return F.struct(F.when(c.isNull(), F.lit(default)).when(valid, number.cast("int")).alias("value"), valid.alias("valid"))


def bounded_text(c: Column, low: int, high: int) -> Column:
    """struct(value, valid) of a parameter: blanks round it go, its length must lie within bounds; none is valid."""
    t = F.trim(c)
    return F.struct(F.when(F.length(t).between(low, high), t).alias("value"), F.coalesce(F.length(t).between(low, high), F.lit(True)).alias("valid"))


def retry_wait(kind: Column, suggested: Column, attempt: Column, attempts: int = 3) -> Column:
    """Milliseconds to wait after a failed attempt (from 0); null where it is not tried again: lasting failures, the last attempt, long waits."""
    again = (kind != "permanent") & (attempt < attempts - 1) & F.coalesce(suggested <= fixed.LONGEST_WAIT_SECONDS, F.lit(True))
    usual = F.get(F.array(*map(F.lit, fixed.BACKOFF_MS)), F.least(attempt, F.lit(len(fixed.BACKOFF_MS) - 1)).cast("int"))
    return F.when(again, F.coalesce((F.ceil(suggested * 1000) + 250).cast("int"), usual))
