"""The pipeline's stages on a small corpus, each against a plain count of what it should do."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

GOOD = "the river and the old mill of the town was known for a long winter in which {} people of the valley went to the market with bread and wine and with songs that no one else had ever heard before number {}"


def test_pipeline(spark, tmp_path):
    rows = [(k, GOOD.format(f"kind{k} tall{k} from{k}", f"{k} is {k * k} or {k * 7} then {k + 5} again {k * 11} times over"), "en", "s", 100) for k in range(8)]
    rows += [(20, "too short", "en", "s", 9), (21, rows[0][1], "en", "s", 100), (22, None, "en", None, None), (23, "### $$$ %%% " * 40, "en", "s", 400)]
    rows += [(30, "it is not in the house of the king that the token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" was found by the men on their way from the sea to a far and cold land", "en", "s", 150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name], docs = out.collect(), out
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert kept == {*range(8), 21, 30}
    heads = {r.doc_id for r in seen["simhash_near_dedup"]}
    assert 21 not in heads and {0, 30} <= heads
    cut = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert cut[0] == rows[0][1] and all(len(cut[k]) < len(rows[k][1]) for k in cut if k in heads and 0 < k < 8)
    safe = {r.doc_id: r for r in seen["secret_scan"]}
    assert "[secret]" in safe[30].text and not re.search("[0-9a-f]{40}", safe[30].text) and safe[30].n_chars == len(safe[30].text)
    assert {r.doc_id for r in seen["packing"]} == set(safe)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen["packing"]))


def five_word_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(30)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randrange(25, 160))] + common * (k % 3 == 0)
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):  # Jaccard from well below 0.8 to 0.98
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["one two", "one two three", "One  two", " ".join(common)]
    sets, root = five_word_sets(texts), list(range(len(texts)))
    alike = lambda a, b: a and 10 * len(a & b) >= 8 * len(a | b)
    for i, a in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 40 < len(set(root)) < len(texts) - 60
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns
    stay = sorted(r.doc_id for r in left.collect())
    # every group keeps its least, no two that stay are alike, and what goes beyond the least of a group is alike to another
    assert {root[k] for k in stay} == set(root) and set(root) <= set(stay)
    assert not [(i, j) for i in stay for j in stay if i < j and alike(sets[i], sets[j])]
    assert len(stay) <= len(set(root)) + 12
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_near_copies_of_a_clique_leave_one(spark):
    """Groups in which all are alike: the result is the brute-force one."""
    rng = random.Random(11)
    rows = []
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for c in range(6):
            copy = list(base)
            if c:
                copy[rng.randrange(len(copy))] = f"x{k}{c}"
            rows.append((k * 10 + c, " ".join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [k * 10 for k in range(30)]


def test_near_copies_without_ids_and_repeated_rows(spark):
    text = [GOOD.format(f"{k} a{k} b{k} c{k}", f"{k} d{k} e{k}") for k in range(4)]
    rows = [(5, text[0]), (5, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (3, text[3]), (3, "another text under the same id that is like no other")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((i or 0, t) for i, t in [rows[0], rows[3], rows[5], *rows[6:]])


def test_stages_pass_columns_of_any_name_and_empty_tables(spark, tmp_path):
    """Extra columns with dots and with names that the operators use; repeated rows; no rows at all; no n_chars."""
    extra = ["a.b", "row", "digest", "share", "near_class", "found", "payload"]
    good = GOOD.format("k0 t0 f0", "0 is 0 or 7 then 5 again 11 times over")
    rows = [(1, good, *extra), (1, good, *extra), (2, None, *extra), (None, good + " or so", *extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))
    for source in (docs, docs.limit(0)):
        got = source
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, got, "")
            assert name == "packing" or out.columns == docs.columns
            path = f"{tmp_path}/{source is docs}{k}"
            out.write.parquet(path)
            got = spark.read.parquet(path)
            assert name == "packing" or all(r["a.b"] == "a.b" and r["row"] == "row" for r in got.collect())
        assert (got.count() > 0) == (source is docs)


def test_tables_of_a_stage_go(spark, tmp_path):
    """What a stage left is removed when the next one begins; ``run`` leaves nothing but its result."""
    import os

    from vitaloom.llm import common

    spark.createDataFrame([(k, GOOD.format(f"k{k} t{k}", f"{k} is {k * k} or {k * 7}"), 1) for k in range(3)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    new = set(os.listdir(folder)) - before
    assert rows and len([n for n in new if n.startswith("vitaloom-")]) == 1
