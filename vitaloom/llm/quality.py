"""Quality rules: one threshold table compiled into one Spark projection of text measures.

No user function runs: words, shingle hashes and repeat runs are array expressions of Spark SQL.

Defined results: a null or blank text has no words and fails the base rules; texts of any length are measured
whole; repeated rows and rows without id are judged alike; extra columns pass through :func:`judge` untouched unless they carry the
name of a measure, in which case the measure replaces them; :func:`passing` returns all columns as they came, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None
    high: float | None


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is it that was for on are with as be by at this from or an a "
    "der die das und ist nicht ein zu den mit von auf für im dem sie "
    "le la les de des et un une est que dans pour qui par sur pas avec du au "
    "el los las y en no se su por con para del lo como más o".split()
)

#: A row fails when its measure lies outside [low, high]. Applied to texts that pass the base rules.
THRESHOLDS = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("longest_word", "longest_word", None, 1000.0),
)


def _array(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "dup_line_ratio", "stop_word_ratio", "longest_word")
VERDICTS = ("base_failed", "kept")


def measures(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``row``, all columns of ``df``, and every measure as a column. Three projections: words, window hashes, counts."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    n = F.size("_w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    df = df.withColumn("_w", _array(text)).withColumn("_l", lines)

    def doubled(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    # hashes of windows by doubling: 1, 2, 4, 8 words; the tail, where a window would leave the text, is cut off
    df = df.withColumn("_h", F.when(n >= window, F.transform("_w", lambda w: F.xxhash64(w))))
    step = 1
    while step < window:
        df = df.withColumn("_h", doubled(F.col("_h"), step))
        step *= 2
    if step != window:
        raise ValueError("window must be a power of two")
    df = df.withColumn("_h", F.slice("_h", 1, n - window + 1))
    df = df.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))))
    # starts of windows found twice or more, in order; each covers up to `window` words until the next one
    starts = F.array_sort(F.transform(F.filter("_o", lambda x, k: F.coalesce(F.get("_o", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_o", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("_s", starts)
    spans = F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    repeat = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, b: a + b), F.lit(0))
    chars = F.length(F.array_join("_w", ""))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": chars.cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeat.cast("long"),
            "_n_lines": F.size("_l"),
        }
    )
    stop = F.array(*map(F.lit, STOP_WORDS))
    total = F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / total,
            "symbols_per_word": F.col("n_symbols") / total,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "stop_word_ratio": F.size(F.filter("_w", lambda w: F.array_contains(stop, F.lower(w)))) / total,
            "longest_word": F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double"),
        }
    )
    return df.select("row", *MEASURES)


def verdict(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The table as one condition: true if every measure lies within its bounds."""
    kept = F.lit(True)
    for r in rules:
        if r.low is not None:
            kept &= F.col(r.measure) >= r.low
        if r.high is not None:
            kept &= F.col(r.measure) <= r.high
    return kept


def _judged(df: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    df = measures(df, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """``df`` with its measures, ``base_failed`` and ``kept``."""
    own = [F.col("row")[c].alias(c) for c in df.columns if c not in (*MEASURES, *VERDICTS)]
    return _judged(df, text_col, rules).select(*own, *MEASURES, *VERDICTS)


def passing(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns.

    The row number keeps the optimizer from moving the filter below the measures: it would write each measure out in
    terms of all before it, which multiplies at every step.
    """
    judged = _judged(df, text_col, rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*[F.col("row")[c].alias(c) for c in df.columns])
