"""English stems by the published Porter2 rules, for distinct words in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    first = head if head is not None else (m.end() if (m := re.search(f"[{_V}][^{_V}]", w)) else len(w))
    second = first + m.end() if (m := re.search(f"[{_V}][^{_V}]", w[first:])) else len(w)
    return first, second


def _ends_short(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"('s'|'s|')$", "", word.lstrip("'"))
    w = re.sub(f"(?<=[{_V}])y", "Y", "Y" + w[1:] if w.startswith("y") else w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in KEPT:
        return w
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    end = next((s for s in sorted([*STEP2, "ogi", "li"], key=len, reverse=True) if w.endswith(s)), None)
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(end)] + STEP2[end]
    end = next((s for s in sorted([*STEP3, "ative"], key=len, reverse=True) if w.endswith(s)), None)
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    end = next((s for s in (*STEP4, "ion") if w.endswith(s)), None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Words that a task keeps the stems of; with more it begins anew.
KEPT_STEMS = 500_000


def stemmed(terms: DataFrame, col: str = "term") -> DataFrame:
    """``terms`` with ``col`` as its stem; null words go. A task works out each distinct word once, where the word is: no shuffle and no join back."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for words in batches:
            if len(known) > KEPT_STEMS:
                known.clear()
            said = words.tolist()
            known.update((w, stem(w)) for w in set(said) if w not in known)
            yield pd.Series([known[w] for w in said], dtype=object)

    # not deterministic, so that the optimizer neither repeats it in a filter nor moves a join below it
    return terms.where(F.col(col).isNotNull()).withColumn(col, run.asNondeterministic()(F.col(col)))
