"""Vector codes, token counts and importance resampling against brute force and the library, with odd inputs each."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vitaloom.llm import codes, importance, tokens

P = pytest.importorskip("public_tokenizers")
BYTES = P.path("byte_bpe_50k.json")


def lloyd(rows, parts, entries, rounds, scale=256):
    """Plain Lloyd on Python integers: codes, errors and final books of (id, vector, label) rows in order."""
    xs = [[math.floor(scale * float(c)) for c in v] for _, v, _ in rows]
    w = len(xs[0]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for x in xs[:entries]] for p in range(parts)]

    def assign():
        out = []
        for x in xs:
            best = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(cut(x, p), e, strict=True)) for e in books[p]]
                best.append((d.index(min(d)), min(d)))
            out.append(best)
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(x, p) for x, n in zip(xs, near, strict=True) if n[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{e:02x}" for e, _ in n), sum(d for _, d in n)) for n in assign()], books


def vectors(kind, n, d, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        return (rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, d))).astype(np.float32)
    if kind == "ties":
        return rng.integers(0, 3, (n, d)).astype(np.float32) / 256
    return rng.normal(size=(n, d)).astype(np.float32)


@pytest.mark.parametrize("kind", ["clusters", "ties", "spread"])
def test_codes_equal_lloyd(spark, kind, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 50)
    x = vectors(kind, 300, 8)
    rows = [(5 * i % 300, [float(c) for c in v], None if i % 7 == 0 else i % 3, "x", 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1, "x", 1), (1001, [float("nan")] * 8, 1, "x", 1), (1002, [float("inf")] + [0.0] * 7, 1, "x", 1), (1003, [None] * 8, None, "x", 1), (-5, [0.5] * 4, 1, "x", 1), (-6, [], 1, "x", 1)]
    repeated = [(0, [1.0] * 8, 2, "x", 1), (0, [1.0] * 8, 2, "x", 1), (None, [0.25] * 8, None, "x", 1)]
    df = spark.createDataFrame(rows + bad + repeated, "vec_id long, embedding array<float>, label int, v string, ids int").repartition(3)
    got = codes.code_digests(df, parts=4, entries=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    kept = sorted(((i, v, lab) for i, v, lab, *_ in rows + repeated), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, books = lloyd(kept, 4, 16, 3)
    per_label = Counter()
    for (_, _, lab), (_, e) in zip(kept, want, strict=True):
        per_label[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert Counter(map(tuple, got.collect())) == Counter((i, c, e, per_label[lab], digest) for (i, _, lab), (c, e) in zip(kept, want, strict=True))


def test_heaps_spare_most_measurements(spark):
    x = vectors("clusters", 4000, 16)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    _, _, looked = codes.compress(df, parts=4, entries=16, rounds=4)
    assert looked[0] == 16_000 and looked[-1] < 0.5 * looked[0]


def test_codes_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(3, [0.5, -0.5, 1.0, 2.0], None), (1, [0.1, 0.2, 0.3, 0.4], "a")], "vec_id long, embedding array<double>, label string")
    got = codes.code_digests(df, parts=2).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "0000", 0, 0), (3, "0101", 0, 0)]
    for none in (df.limit(0), spark.createDataFrame([(1, None, "a"), (2, [], "a")], df.schema)):
        assert codes.code_digests(none, parts=2).count() == 0
    with pytest.raises(ValueError):
        codes.code_digests(df, parts=3)
    with pytest.raises(Exception, match="64-bit"):
        codes.code_digests(spark.createDataFrame([(1, [1e9, 0.0], 0)], "vec_id long, embedding array<double>, label int"), parts=2)


def test_more_entries_than_a_byte(spark):
    x = vectors("spread", 700, 4, seed=3)
    out, books, _ = codes.compress(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"), parts=2, entries=300, rounds=1)
    want, ref = lloyd([(i, v.tolist(), 0) for i, v in enumerate(x)], 2, 300, 1)
    assert books.tolist() == ref and [r.error for r in out.orderBy("vec_id").collect()] == [e for _, e in want]


ODD = ["", "a", " ", "\n\n  x", "it's I'LL we've", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "日本語 ÄÖ ß é 🎉‍🔥", "x" * 3000, "ab" * 20000, "1234567 12a3", "tab\there\r\nnew\x0b\x1c\x85　end", "՘࢏ new letters \U000107bb!", "é́ ö", "\x00\x01\x7f", "don't stop!!! ... --- ===", "    indented\n        more"]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(BYTES), np.random.default_rng(2)
    mixed = ["".join(chr(c) for c in rng.integers(1, 0x3000, 200)) for _ in range(30)] + ["".join(rng.choice(list("ab c'\n1!é"), 300)) for _ in range(100)]
    texts = [*ODD, *mixed, None, "a"]
    df = spark.createDataFrame([(i, t, 9, "n") for i, t in enumerate(texts)] + [(None, "no id", 9, "n")], "doc_id long, text string, n_tokens int, over_limit string").repartition(3)
    got = {r.doc_id: tuple(r) for r in tokens.count_tokens(df, BYTES).collect()}
    for i, t in [*enumerate(texts), (None, "no id")]:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (i, len((t or "").encode()), n, n > 512), t
    assert tokens.count_tokens(df.limit(0), BYTES).count() == 0


def test_token_counts_around_every_character():
    from tokenizers import Tokenizer

    c, lib = tokens.counter(BYTES), Tokenizer.from_file(BYTES)
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"a{x}1{x}!{x} {x}" for x in every[k : k + 256]) for k in range(0, len(every), 256)]
    assert [c.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_with_a_small_store(monkeypatch):
    monkeypatch.setattr(tokens, "STORE_UNITS", 3)
    c = tokens.TokenCounter(BYTES)
    assert c.count("the quick brown fox jumps over the lazy dog and the quick fox") == 13 and len(c) <= 3


def resampled(docs, target, n=1, buckets=10_000, min_words=20, percent=10):
    """Plain statement of the operator: rows of (doc_id, n_features, weight, score, rank)."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def feats(t):
        w = word.findall((t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    made = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(f for _, _, fs in made for f in fs), Counter(f for x in target for f in feats(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, words, fs in made:
        weight = sum(map(gain, fs))
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(fs), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    number, place = percent * len(able) // 100, {}
    for k, r in enumerate(able[:number], 1):
        place[id(r)] = k
    return Counter((r[0], r[2], r[3], r[4], place.get(id(r))) for r in rows)


def corpus(n, seed=5):
    rng = np.random.default_rng(seed)
    words = np.array(["Alpha", "beta", "GAMMA", "x1", "é", "日本", "d-e", "it's", "z"])
    return [(i * 3 - 50, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 40)
    monkeypatch.setattr(importance, "BLOCK_BITS", 3)
    docs = corpus(400) + [(7, None), (8, ""), (None, "beta " * 30), (None, None), (9, "word " * 3000), (10, "x" * 5000)]
    docs += [docs[3], docs[3], (docs[3][0], "beta " * 25)]
    target = ["alpha x1 beta gamma", None, "", "日本 z"]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, block string, score int").repartition(3)
    want = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(df, want, n=n, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled(docs, target, n=n, buckets=500)


def test_resampling_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(df.limit(0), df).count() == 0
    assert [tuple(r) for r in importance.resample(df, df.limit(0)).collect()] == list(resampled([(1, "a b c")], []))


def test_draw_among_equal_scores(spark, monkeypatch):
    """One score that most documents have is ranked by id over many blocks, and cut within a block."""
    monkeypatch.setattr(importance, "BLOCK_BITS", 4)
    rows = [(i, 30, 30, 0, 5 if i % 10 else i) for i in range(1000)] + [(2000, 3, 3, 0, 99), (2001, 30, 30, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = {r.doc_id: r["rank"] for r in importance.draw(df, percent=40).collect()}
    order = sorted((r for r in rows if r[0] < 2000), key=lambda r: (-r[4], r[0]))
    assert got == {2000: None, 2001: None} | {r[0]: k if k <= 400 else None for k, r in enumerate(order, 1)}
