"""Personal data in text: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find the base spans. Round cues that no base span covers (digits, at and dot words) the text is cut into
tokens, and a semi-Markov CRF scores whole candidate segments: features see the entire span (digits, groups, checksum,
separators, words before it), and each pair of neighbouring segment types has a weight of its own. A dynamic program over
segments of at most ``MAX_TOKENS`` tokens picks boundaries and types together. Base spans part the text before it, so
they always stay.

The model is fitted by maximum conditional likelihood (forward-backward over segments) on generated
sentences with known spans, the same ones every time; ``TRAIN_SENTENCES`` bounds them.

Defined results: null and empty texts have no spans, a text of any length is read whole in time linear in it, digits are
those of ASCII, repeated rows have equal results, a row without id has spans like any other, extra columns are ignored,
an empty table gives an empty table. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitaloom.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 15
TRAIN_SENTENCES = 240
#: The base patterns. A run of digits is taken whole or not at all, which changes no match.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_CUE = re.compile(r"[0-9]{2,}+|(?<![0-9])[0-9](?=[\s.(\[]{1,3}[0-9])|[0-9](?=[\s(\[]{1,2}dot\b)|@|[(\[{] ?(?:at|dot) ?[)\]}]|\bdot\b", re.IGNORECASE | re.ASCII)
_AT_WORD = re.compile(r"@|\bat\b", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
REACH = 70
#: Characters of a token that the features read; no feature tells longer tokens apart.
TOKEN_CHARS = 64


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _digits(token: str) -> bool:
    return "0" <= token[0] <= "9"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and without overlap for each kind; failing matches are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(("email", m.start(), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if 12 <= len(m[0]) <= 37 and 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the model -------------------------------------------------------------------------------------------------

#: Words that go before each kind.
BEFORE = {
    "email": {"mail", "email", "contact", "write", "kontakt", "correo", "courriel", "an"},
    "ip": {"ip", "server", "host", "address", "gateway", "dns", "adresse"},
    "card": {"card", "visa", "karte", "carte", "tarjeta", "mastercard", "credit"},
    "phone": {"tel", "phone", "call", "fax", "telefon", "telefono", "mobile", "mobil", "whatsapp", "ruf"},
}
_AT, _DOT = {"@", "at", "＠"}, {".", "dot"}


def _span_features(tokens: list[str], gaps: list[bool], i: int, j: int) -> list[float] | None:
    """Features of tokens i..j-1 as one segment; None where it can be no entity at all."""
    part = tokens[i:j]
    digits = "".join(t for t in part if _digits(t))
    n = len(digits)
    at = [k for k, t in enumerate(part) if t.lower() in _AT]
    if n < 4 and not at or n > 24:
        return None
    first, last = part[0], part[-1]
    if not (first[0].isalnum() or first in "+(") or not last[0].isalnum():
        return None
    words = [t for t in part if t[0].isalpha() and t.lower() not in _AT and t.lower() not in _DOT]
    dots = sum(t.lower() in _DOT for t in part)
    groups = [t for t in part if _digits(t)]
    marks = [t for t in part if not t[0].isalnum()]
    quad = len(groups) == 4 and all(map(_octet, groups)) and not words and dots == 3
    even = len(set(marks)) <= 1
    mail = len(at) == 1 and 0 < at[0] < len(part) - 3 and dots >= 1 and len(words) >= 3 and all(len(w) < 25 for w in words)
    if mail and part[at[0]].lower() == "at" and part[at[0] - 1] not in "([{":
        mail = any(t.lower() == "dot" for t in part)  # a bare "at" with a full stop is prose
    gap = sum(gaps[i + 1 : j])
    before = {t.lower() for t in tokens[max(0, i - 3) : i]}
    return [
        1.0,
        float(mail),
        float(bool(at) and not mail),
        float(mail and part[-2].lower() in _DOT or mail and len(part) > 2 and part[-3].lower() in _DOT),
        float(mail and 2 <= len(last) <= 6),
        float(mail and (i == 0 or gaps[i] and not tokens[i - 1].lower() in _DOT)),
        float(quad),
        float(quad and even),
        float(7 <= n <= 8),
        float(9 <= n <= 13),
        float(n in (14, 15)),
        float(n == 16),
        float(n > 19 or n < 7),
        float(12 <= n <= 19 and luhn(digits)),
        float(12 <= n <= 19 and not luhn(digits)),
        float(len(groups) == 4 and all(len(g) == 4 for g in groups)),
        float(first in "+(" or digits.startswith("0")),
        float(len(groups) >= 3),
        float(len(groups) == 1),
        float(bool(words) and not mail),
        float(any(m not in "+-()./[]{}" for m in marks) and not mail),
        float(even),
        min(gap, 4) / 4,
        len(part) / MAX_TOKENS,
        *[float(bool(before & BEFORE[k])) for k in KINDS],
        float(j < len(tokens) and not gaps[j] and tokens[j][0].isalnum() or i > 0 and not gaps[i] and tokens[i - 1][0].isalnum()),
        float(j < len(tokens) and _digits(tokens[j]) or i > 0 and _digits(tokens[i - 1])),
    ]


WIDTH = 30


def _lattice(tokens: list[str], gaps: list[bool]) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans, rows = [], []
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if (f := _span_features(tokens, gaps, i, j)) is not None:
                spans.append((i, j))
                rows.append(f)
    return spans, np.array(rows, float).reshape(len(rows), WIDTH)


class SemiMarkov:
    """Segment scores are linear in the features; a token outside every entity is a segment of its own with score 0.

    ``t[y, z]`` is added where a segment of type z follows one of type y; the last type stands for the single tokens.
    """

    def __init__(self) -> None:
        self.w = np.zeros((WIDTH, len(KINDS)))
        self.w[0] = -2.0
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    @staticmethod
    def _by_end(spans, n):
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(spans):
            ends[j].append(k)
        return ends

    def gradient(self, spans, f, n, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the log-likelihood of one sentence, for w and t: counts in truth less expected counts."""
        score, out = f @ self.w, len(KINDS)
        ends = self._by_end(spans, n)
        # into[j, y]: all ways to the place j, seen by a segment of type y that starts there; by[j, y]: those that end there in type y
        by, into = np.full((n + 1, out + 1), -np.inf), np.full((n + 1, out + 1), -np.inf)
        into[0] = self.t[out]  # a text begins as after a single token
        for j in range(1, n + 1):
            by[j, out] = into[j - 1, out]
            if ends[j]:
                by[j, :out] = np.logaddexp.reduce([into[spans[k][0], :out] + score[k] for k in ends[j]], axis=0)
            into[j] = np.logaddexp.reduce(by[j][:, None] + self.t, axis=0)
        total = np.logaddexp.reduce(by[n])
        # after[j, y]: all ways from the place j to the end, after a segment of type y
        after, begins = np.zeros((n + 1, out + 1)), [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(spans):
            begins[i].append(k)
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for j in range(n - 1, -1, -1):
            start = np.full(out + 1, -np.inf)  # all ways that begin with a segment of each type
            start[out] = after[j + 1, out]
            if begins[j]:
                start[:out] = np.logaddexp.reduce([score[k] + after[spans[k][1], :out] for k in begins[j]], axis=0)
            if j:
                gt -= np.exp(by[j][:, None] + self.t + start - total)
            else:
                gt[out] -= np.exp(self.t[out] + start - total)
            after[j] = np.logaddexp.reduce(self.t + start, axis=1)
        if len(spans):
            own = np.array([into[i, :out] + after[j, :out] for i, j in spans])
            gw -= f.T @ np.exp(score + own - total)
        at, last = 0, out
        places = {i: (k, j) for k, (i, j) in enumerate(spans) if (i, j) in gold}
        while at < n:
            k, end = places.get(at, (-1, at + 1))
            kind = gold[spans[k]] if k >= 0 else out
            gt[last, kind] += 1
            if k >= 0:
                gw[:, kind] += f[k]
            at, last = end, kind
        return gw, gt

    def fit(self, sentences, epochs: int = 8, rate: float = 0.5, shrink: float = 1e-3) -> SemiMarkov:
        seen_w, seen_t = np.full_like(self.w, 1e-3), np.full_like(self.t, 1e-3)
        data = []
        for text, spans in sentences:
            tokens, gaps, places = tokenise(text, 0)
            starts, stops = {p[0]: k for k, p in enumerate(places)}, {p[1]: k + 1 for k, p in enumerate(places)}
            gold = {(starts[b], stops[e]): KINDS.index(kind) for kind, b, e in spans if b in starts and e in stops}
            data.append((*_lattice(tokens, gaps), len(tokens), gold))
        for _ in range(epochs):
            for spans, f, n, gold in data:
                gw, gt = self.gradient(spans, f, n, gold)
                gw, gt = gw - shrink * self.w, gt - shrink * self.t
                seen_w += gw * gw
                seen_t += gt * gt
                self.w += rate * gw / np.sqrt(seen_w)
                self.t += rate * gt / np.sqrt(seen_t)
        return self

    def best(self, spans, f, n) -> list[tuple[int, int, int]]:
        """Highest-scoring segmentation: (first token, end token, kind) of its entities."""
        if not len(spans):
            return []
        score, out = (f @ self.w).tolist(), len(KINDS)
        t, ends = self.t.tolist(), self._by_end(spans, n)
        kinds = range(out + 1)
        # value[j][y]: best way to the place j whose last segment is of type y; back[j][y]: (segment, type before)
        value, back = [[-np.inf] * out + [0.0]], [[(-1, out)] * (out + 1)]
        into = []
        for j in range(n + 1):
            if j:
                value.append([-np.inf] * out + [into[j - 1][out][0]])
                back.append([(-1, out)] * out + [(-1, into[j - 1][out][1])])
                for k in ends[j]:
                    for y in range(out):
                        v, before = into[spans[k][0]][y]
                        if v + score[k][y] > value[j][y]:
                            value[j][y], back[j][y] = v + score[k][y], (k, before)
            own = value[j]
            into.append([max((own[y] + t[y][z], y) for y in kinds) for z in kinds] if ends_or_starts(j, out, own) else [(own[out] + t[out][z], out) for z in kinds])
        found, j = [], n
        y = max(kinds, key=lambda y: value[n][y])
        while j > 0:
            k, before = back[j][y]
            if y < out:
                found.append((*spans[k], y))
            j, y = (spans[k][0] if y < out else j - 1), before
        return found[::-1]


def ends_or_starts(j: int, out: int, own: list[float]) -> bool:
    """Whether any entity ends here, so that more than the single token can come before."""
    return any(v > -np.inf for v in own[:out])


def tokenise(text: str, offset: int) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    tokens, gaps, places, last = [], [], [], 0
    for m in _TOKEN.finditer(text):
        tokens.append(m[0][:TOKEN_CHARS])
        gaps.append(m.start() > last)
        places.append((m.start() + offset, m.end() + offset))
        last = m.end()
    return tokens, gaps, places


def sentences(count: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with their spans: written-out and spaced forms, pattern forms, and look-alikes without spans."""
    r = random.Random(seed)
    filler = "the and of was for with from under about die und der nicht mit les dans pour que los una para con paper house river light winter green order said went new".split()
    names = "anna tom maria jan lea paul nora emil ines luc karl rosa".split()
    hosts = "mail web post inbox example office uni firma".split()
    tops = "com org net de fr es edu".split()
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card_number() -> str:
        body = r.choice("45") + num(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            user = r.choice(names) + r.choice(["", "", num(2)])
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", " . "), ("@", " dot "), (" (at) ", "."), (" {at} ", " {dot} ")])
            return kind, user + at + r.choice(hosts) + dot + r.choice(tops)
        if kind == "ip":
            return kind, r.choice([" . ", "[.]", " dot ", ".", "(.)"]).join(str(r.randint(0, r.choice([9, 255, 255]))) for _ in range(4))
        if kind == "card":
            c = card_number()
            return kind, r.choice([".", "/", " / ", " . ", "-"]).join(c[k : k + 4] for k in range(0, 16, 4))
        return kind, r.choice([
            lambda: f"0{num(2)} {num(4)} {num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"00{num(2)}-{num(2)}-{num(6)}",
            lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0{num(3)}/{num(7)}", lambda: f"+ {num(2)} {num(3)} {num(6)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
        ])()

    def look_alike() -> str:
        return r.choice([
            lambda: f"{r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 99)}.{num(2)}",
            lambda: num(16), lambda: f"no {num(5)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{num(3)} at {r.choice(hosts)} {r.choice(filler)}",
            lambda: f"{r.choice(names)} at {r.choice(hosts)}", lambda: f"{num(2)} {num(3)} {num(3)} people", lambda: f"{r.choice('abcdef')}{num(6)}{r.choice('abcdef')}{num(5)}",
            lambda: f"pages {num(3)} - {num(3)}", lambda: f"{num(2)}:{num(2)}", lambda: f"the dot {r.choice(filler)}", lambda: f"{num(5)} {num(4)} items",
        ])()

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(filler) for _ in range(r.randint(1, 5))) + " "
            if r.random() < 0.55:
                kind, e = entity()
                if r.random() < 0.5:
                    text += r.choice(sorted(BEFORE[kind])) + r.choice([" ", ": "])
                spans.append((kind, len(text), len(text) + len(e)))
                text += e
            else:
                text += look_alike()
            text += r.choice([" ", ", ", ". "])
        out.append((text + r.choice(filler), spans))
    return out


@functools.lru_cache(maxsize=1)
def model() -> SemiMarkov:
    return SemiMarkov().fit(sentences(TRAIN_SENTENCES))


def added_spans(text: str, base: list[tuple[str, int, int]], crf: SemiMarkov) -> list[tuple[str, int, int]]:
    """Segments that the model finds outside the base spans."""
    windows: list[list[int]] = []
    covered = sorted((b, e) for _, b, e in base)
    k = 0
    for m in _CUE.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start():
            continue
        lo, hi = max(0, m.start() - REACH), m.end() + REACH
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    out, done = [], 0
    for lo, hi in windows:
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        lo, hi = max(lo, done), max(hi, done)
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        done = hi
        # base spans part the window, so no segment can touch one
        k, at = bisect.bisect_left(covered, (lo, lo)), lo
        pieces = []
        if k and covered[k - 1][1] > at:
            at = covered[k - 1][1]
        while k < len(covered) and covered[k][0] < hi:
            pieces.append((at, covered[k][0]))
            at = max(at, covered[k][1])
            k += 1
        for b, e in [*pieces, (at, min(hi, len(text)))]:
            if b >= e:
                continue
            for line in re.finditer("[^\n]+", text[b:e]):
                s = line[0]
                if len(re.findall("[0-9]", s)) < 4 and not _AT_WORD.search(s):
                    continue
                tokens, gaps, places = tokenise(s, b + line.start())
                for i, j, kind in crf.best(*_lattice(tokens, gaps), len(tokens)):
                    out.append((KINDS[kind], places[i][0], places[j - 1][1]))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans: array<struct<kind, start, end>>, in order of start and kind."""
    crf = model()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lambda spans: [{"kind": k, "start": b, "end": e} for k, b, e in spans]
        for batch in batches:
            base, full = [], []
            for t in batch.column("text").to_pylist():
                base.append(b := base_spans(t))
                full.append(in_order(b + added_spans(t, b, crf)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shape(x) for x in base], span), pa.array([shape(x) for x in full], span)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: int, end: int>>"
    return texts_of(docs).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, count of base spans by kind, base_sha256, all spans as text."""
    from pyspark.sql import functions as F

    found = find_spans(docs)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
