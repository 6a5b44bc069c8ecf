"""Owner-scoped nearest vectors, the search grammar, positional index and cover density."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaloom.operators import lexical, retrieval


def exact(chunks, queries, n):
    out = {}
    for qid, qo, q in queries:
        if q is None or qo is None or not np.linalg.norm(q):
            continue
        found = []
        for cid, co, v in chunks:
            if v is not None and co == qo and len(v) == len(q) and np.linalg.norm(v):
                found.append((-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 4), cid))
        if found:
            out[qid] = [(c, -s) for s, c in sorted(found)[:n]]
    return out


def test_dense_arm_in_shares(spark, monkeypatch):
    """An owner that holds most rows is dealt over several shares of chunks and of queries; none is lost, none is counted twice."""
    monkeypatch.setattr(retrieval, "SHARE_CHUNKS", 40)
    monkeypatch.setattr(retrieval, "SHARE_QUERIES", 7)
    rng = np.random.default_rng(1)
    vec = lambda d: [float(x) for x in rng.integers(-2, 3, d)]
    chunks = [(i, "big" if i % 3 else f"o{i % 5}", vec(4)) for i in range(300)] + [(900, "big", None), (901, "big", [0.0] * 4), (902, "big", [1.0, 2.0]), (903, None, vec(4)), (904, "nobody", vec(4))]
    queries = [(i, ("big", "o0", "o1", "gone")[i % 4], vec(4)) for i in range(60)] + [(70, "big", None), (71, None, vec(4)), (72, "big", [0.0] * 4), (73, "big", [3.0, 1.0])]
    c = spark.createDataFrame(chunks, "cid long, owner string, v array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, owner string, q array<double>").repartition(3)
    got = {}
    for r in retrieval.dense_arm(c, q, "cid", "v", n=6, digits=4, owner="owner").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.cid, r.score))
    assert got == exact(chunks, queries, 6)
    whole = retrieval.dense_arm(c.drop("owner"), q.drop("owner"), "cid", "v", n=3, digits=4).where("query_id = 5").orderBy("rank").collect()
    assert [(r.cid, r.score) for r in whole] == exact([(i, 0, v) for i, _, v in chunks], [(i, 0, v) for i, _, v in queries], 3)[5]
    assert retrieval.dense_arm(c.limit(0), q, "cid", "v", owner="owner").count() == 0


def test_dense_arm_has_no_nested_loop_and_sorts_only_the_best(spark):
    c = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    q = c.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plan = retrieval.dense_arm(c, q, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize(
    ("text", "any_term", "terms", "tree"),
    [
        ("metformin dose", True, ["metformin", "dose"], '["or", ["term", 0], ["term", 1]]'),
        ("metformin dose", False, ["metformin", "dose"], '["and", ["term", 0], ["term", 1]]'),
        ('"chest pain" -fever', True, ["chest", "pain", "fever"], '["or", ["phrase", 0, 0, 1, 1], ["not", ["term", 2]]]'),
        ('-"chest pain"', True, ["chest", "pain"], '["not", ["phrase", 0, 0, 1, 1]]'),
        ("a1 b1 or c1", False, ["a1", "b1", "c1"], '["or", ["and", ["term", 0], ["term", 1]], ["term", 2]]'),
        ('"open quote', False, ["open", "quote"], '["phrase", 0, 0, 1, 1]'),
        ("follow-up", False, ["follow", "up"], '["phrase", 0, 0, 1, 1]'),
        ("or", False, [], None), ("", False, [], None), (None, True, [], None), ("?! --", True, [], None),
        ("x x", False, ["x"], '["and", ["term", 0], ["term", 0]]'),
    ],
)
def test_grammar(text, any_term, terms, tree):
    assert lexical.parsed(text, False, any_term) == (terms, tree)


def test_grammar_leaves_distances_of_stop_words():
    assert lexical.parsed('"pain in the chest"', True, True) == (["pain", "chest"], '["phrase", 0, 0, 1, 3]')
    assert lexical.parsed("am I allergic to anything", True, True) == (["allerg", "anyth"], '["or", ["term", 0], ["term", 1]]')
    assert lexical.parsed("the of", True, True) == ([], None)


def literal(words, tree):
    """Cover density as its definition reads, on the words themselves; None where the text does not match."""

    def holds(node, a, b):
        kind = node[0]
        if kind == "term":
            return node[1] in words[a : b + 1]
        if kind == "phrase":
            return any(all(s + d <= b and words[s + d] == w for w, d in zip(node[1::2], node[2::2], strict=True)) for s in range(a, b + 1))
        if kind == "not":
            return not holds(node[1], a, b)
        return (all if kind == "and" else any)(holds(n, a, b) for n in node[1:])

    def named(node):
        return {node[1]} if node[0] == "term" else set(node[1::2]) if node[0] == "phrase" else set().union(*map(named, node[1:]))

    places = [i for i, w in enumerate(words) if w in named(tree)]
    if not places or not holds(tree, 0, len(words) - 1):
        return None
    total, start = 0.0, 0
    while start < len(places):
        end = next((e for e in range(start, len(places)) if holds(tree, places[start], places[e])), None)
        if end is None:
            break
        begin = next(b for b in range(end, -1, -1) if holds(tree, places[b], places[end]))
        total += 0.1 / (1 + places[end] - places[begin] - (end - begin))
        start = begin + 1
    return round(total, 9)


TREES = [["or", ["term", "a"], ["term", "b"]], ["and", ["term", "a"], ["term", "b"], ["term", "c"]], ["phrase", "a", 0, "b", 1], ["or", ["phrase", "a", 0, "b", 1, "a", 2], ["term", "c"]], ["and", ["phrase", "a", 0, "b", 2], ["term", "c"]],
         ["or", ["term", "a"], ["not", ["term", "b"]]], ["and", ["term", "a"], ["not", ["phrase", "b", 0, "c", 1]]], ["or", ["and", ["term", "a"], ["term", "b"]], ["phrase", "c", 0, "c", 1], ["not", ["term", "d"]]]]


def numbered(tree, terms):
    """The tree with places of terms in place of words."""
    if tree[0] == "term":
        return ["term", terms.index(tree[1])]
    if tree[0] == "phrase":
        return ["phrase", *(terms.index(x) if isinstance(x, str) else x for x in tree[1:])]
    return [tree[0], *(numbered(n, terms) for n in tree[1:])]


@pytest.mark.parametrize("tree", TREES)
def test_cover_density_is_its_definition(tree):
    rng, terms = random.Random(str(tree)), list("abcd")
    texts = [list(p) for n in range(5) for p in itertools.product("abcx", repeat=n)] + [rng.choices("aabbccddxxxx", k=rng.randint(5, 40)) for _ in range(300)]
    used = {x for x in str(tree) if x in terms}
    for words in texts:
        places = {k: [i for i, w in enumerate(words) if w == t] for k, t in enumerate(terms) if t in words and f"'{t}'" in str(tree)}
        if not any(places.values()):
            continue
        got = lexical.Chunk(places, numbered(tree, terms)).score()
        assert (None if got is None else round(got, 9)) == literal(words, tree), (words, used)


def test_search_over_a_stored_index(spark, tmp_path):
    texts = {1: "Severe chest pain at night", 2: "pain in the chest, no chest pain", 3: "Chest clear. Pain: none", 4: None, 5: "", 6: "fever and chest pain " * 3, 7: "running runs runner"}
    docs = spark.createDataFrame([(i, i % 2, t) for i, t in texts.items()], "id long, owner int, text string")
    held = lexical.index(docs, "id", "text", "owner")
    lexical.store(held, f"{tmp_path}/index", "id")
    read = spark.read.parquet(f"{tmp_path}/index")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,chest)]" in read.where("term = 'chest'")._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.positions) for r in read.where("term = 'run'").collect()] == [(7, [0, 1])]
    asked = [(1, 0, '"chest pain"'), (2, 1, '"chest pain"'), (3, 0, "chest -fever"), (4, 1, "Running?"), (5, 0, "!!"), (6, 0, None), (7, 1, "pain night")]
    queries = spark.createDataFrame(asked, "query_id long, owner int, text string")
    got = {}
    for r in retrieval.search_arm(read, queries, "id", owner="owner").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert got == {1: [(6, 0.3), (2, 0.1)], 2: [(1, 0.1)], 3: [(6, 0.3), (2, 0.2)], 4: [(7, 0.2)], 7: [(1, 0.2), (3, 0.1)]}
    strict = retrieval.search_arm(held, queries, "id", owner="owner", any_term=False).where("query_id IN (3, 7)").collect()
    assert {(r.query_id, r.id) for r in strict} == {(3, 2), (7, 1)}
    assert retrieval.search_arm(held, queries.limit(0), "id").count() == 0


def test_best_chunks_of_a_task_in_steps(monkeypatch):
    """Batches cut anywhere, few held pairs and sparse counts give the best of each query, equals by the smaller chunk."""
    rng = random.Random(5)
    rows = [(c, rng.sample("pqrstu", rng.randint(0, 3))) for c in range(40) for _ in range(rng.randint(1, 9))]
    counts = Counter((q, c) for c, asked in rows for q in asked)
    want = {q: sorted(((-n, c) for (p, c), n in counts.items() if p == q))[:3] for q in "pqrstu"}
    for held, grouped in ((10**6, 200_000), (5, 7)):
        monkeypatch.setattr(retrieval, "HELD_PAIRS", held)
        monkeypatch.setattr(retrieval._whole_groups, "__defaults__", (grouped,))
        t = pa.table({"c": pa.array([c for c, _ in rows], pa.int64()), "asked": pa.array([a for _, a in rows], pa.list_(pa.string()))})
        got = pa.Table.from_batches(list(retrieval._counted(iter(t.to_batches(max_chunksize=4)), 3))).to_pylist()
        assert {q: sorted((-r["tf"], r["c"]) for r in got if r["q"] == q)[:3] for q in "pqrstu"} == want
    wide = pa.record_batch({"c": pa.array([1, 2]), "asked": pa.array([list(range(3000)), list(range(3000, 6000))])})
    assert sum(map(len, retrieval._counted(iter([wide]), 3))) == 6000


def test_pairs_of_query_and_chunk_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "id long, text string")
    queries = spark.createDataFrame([(q, ["two", "three"]) for q in range(9)], "query_id long, terms array<string>")
    arm = retrieval.lexical_arm(docs, queries, "id", "text", 2)
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L, id#", arm._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, arm.select("query_id", "id", "rank").collect())) == [(q, i, i + 1) for q in range(9) for i in range(2)]


def test_stems_are_made_once_a_word(spark):
    """One call of Python a word on the way to the join, none below it or in a filter."""
    docs = spark.createDataFrame([(1, "running runs"), (2, None), (3, "ran")], "id long, text string")
    queries = spark.createDataFrame([(1, ["Runs".lower()])], "query_id long, terms array<string>")
    arm = retrieval.lexical_arm(docs, queries, "id", "text", stems=True)
    assert arm._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # chunks and queries
    assert [tuple(r) for r in arm.select("query_id", "id", "score", "rank").collect()] == [(1, 1, 0.2, 1)]


def test_chunks_are_scored_once(spark):
    """Python sees a pair of query and chunk once, not once to be filtered and once more to be shown."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, "c")], "id long, text string")
    queries = spark.createDataFrame([(1, '"a b" "c"'), (2, '"b" -"c"')], "query_id long, text string")
    asked = lexical.parsed_queries(queries, "text", False, True)
    found = lexical.searched(lexical.index(docs, "id", "text", english=False), asked, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython [score" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0.2), (1, 3, 0.1), (2, 1, 0.1), (2, 2, 0.1)]


def test_terms_that_a_chunk_lacks_settle_parts_of_a_tree():
    tree = ["and", ["or", ["term", 0], ["phrase", 1, 0, 2, 1]], ["not", ["term", 3]]]
    told = {frozenset(h): lexical._told(tree, frozenset(h)) for h in ([], [0], [0, 3], [1], [1, 2], [1, 2, 3])}
    assert list(told.values()) == [False, True, False, False, None, False]
    assert lexical._reduced(tree, frozenset([0, 1])) == ["term", 0]
    assert lexical._reduced(["or", ["term", 0], ["not", ["term", 1]]], frozenset([0])) is True


def test_what_found_a_chunk_is_worked_out_once(spark):
    """Both arms stand once in the plan of a search and of its coverage, and each found text is read by one join."""
    import __spark_entry__ as entry

    for name in ("hybrid_search", "rerank_coverage"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("MapInArrow"), plan.count("FlatMapCoGroupsInArrow")) == (1, 1), name


def test_coverage_of_a_chunk_that_many_queries_find(spark, monkeypatch):
    """Finds of one chunk in several rows, of queries without terms, of a chunk that is not there; kept columns come along."""
    monkeypatch.setattr(retrieval, "FINDS_A_ROW", 2)
    chunks = spark.createDataFrame([(1, "Blood sugars, high.", "a"), (2, None, "b"), (3, "x" * 9, None)], "id long, text string, section string")
    asked = spark.createDataFrame([(q, ["sugar", "low"] if q % 2 else ["blood", "hig", "blood", "blood sugars"]) for q in range(5)] + [(8, [])], "query_id long, terms array<string>")
    finds = spark.createDataFrame([(q, c, q * 10 + c) for q in (*range(5), 8, 9) for c in (1, 2, 7)], "query_id long, id long, n int")
    got = {(r.query_id, r.id): (r.n, r.section, round(r.coverage, 6)) for r in retrieval.covered(finds, asked, chunks, "id", "text", "section").collect()}
    share = {0: round(1.2 / 3.7, 6), 1: round(1.2 / 2.2, 6)}
    assert got == {(q, c): (q * 10 + c, {1: "a", 2: "b"}.get(c), share[q % 2] if c == 1 and q < 5 else 0.0) for q in (*range(5), 8, 9) for c in (1, 2, 7)}


@pytest.mark.parametrize(("digits", "kinds"), [(4, 5000), (2, 5000), (None, 5000), (4, 30), (1, 3)])
def test_best_of_a_share_is_exact(digits, kinds):
    """What is left out before scores are rounded is never among the best, ties and copies included."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((kinds, 6))[rng.integers(0, kinds, 5000)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, asked = rng.permutation(5000), v[:70]
    who, what, scores = retrieval._best_of_share(pa.chunked_array([pa.array(ids)]), (np.arange(5000), v), pa.chunked_array([pa.array(np.arange(70))]), (np.arange(70), asked), 7, digits)
    near = asked @ v.T
    near = near if digits is None else np.round(near, digits)
    want = np.stack([np.lexsort((ids, -row))[:7] for row in near])
    assert who.to_pylist() == np.repeat(np.arange(70), 7).tolist() and what.to_pylist() == ids[want].ravel().tolist()
    assert scores.tolist() == np.take_along_axis(near, want, 1).ravel().tolist()


@pytest.mark.parametrize("at_once", [1_000_000, 3])
def test_chunks_scored_together_score_as_each_does(monkeypatch, at_once):
    """All trees, one with more terms than a word has bits and one with a minus that a chunk's places decide; many chunks and queries in one step or in many."""
    monkeypatch.setattr(lexical, "SCORED_AT_ONCE", at_once)
    rng, wide = random.Random(7), [f"w{i}" for i in range(70)]
    trees = [*TREES, ["and", ["or", ["term", "a"], ["term", "d"]], ["phrase", "b", 0, "c", 3]], ["or", *(["term", w] for w in wide)]]
    texts = [rng.choices(["a", "b", "c", "d", "x", "x", *wide[:9]], k=rng.randint(1, 40)) for _ in range(150)] + [wide, wide[64:] * 2]
    queries = []
    for q, tree in enumerate(trees * 2):
        terms = [w for w in ("a", "b", "c", "d", *wide) if f"'{w}'" in str(tree)]
        queries.append((f"q{q}", terms, numbered(tree, terms)))
    rows, want = [], {}
    for c, words in enumerate(texts):
        for w in sorted(set(words)):
            who = {}
            for q, terms, tree in queries:
                if w in terms:
                    who.setdefault(str(tree).replace("'", '"'), []).append({"query_id": q, "k": terms.index(w)})
            rows.append({"id": c, "positions": [i for i, x in enumerate(words) if x == w], "asks": [{"tree": t, "who": p} for t, p in who.items()]})
        for q, terms, tree in queries:
            places = {k: [i for i, x in enumerate(words) if x == t] for k, t in enumerate(terms) if t in words}
            score = lexical.Chunk(places, tree).score() if places else None
            if score is not None:
                want[q, c] = round(score, 9)
    kinds = {"id": pa.int64(), "positions": pa.list_(pa.int32()), "asks": pa.list_(pa.struct({"tree": pa.string(), "who": pa.list_(pa.struct({"query_id": pa.string(), "k": pa.int32()}))}))}
    batches = pa.Table.from_pylist(rows, pa.schema(kinds)).to_batches(max_chunksize=50)
    got, known = {}, {}
    for t in lexical._whole_groups(iter(batches), 200):
        for who, what, scores in lexical._scored(t, known):
            for key, score in zip(zip(who.to_pylist(), what.to_pylist()), scores.tolist()):
                assert key not in got
                got[key] = round(score, 9)
    assert got == want


def test_search_shuffles_words_once_and_no_pairs(spark):
    docs = spark.createDataFrame([(i, "one two three" if i % 2 else "two one") for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(q, '"one two" -"four"') for q in range(3)], "query_id long, text string")
    asked = lexical.parsed_queries(queries, "text", False, False)
    terms = F.broadcast(asked.select(F.explode("terms").alias("term")))
    found = lexical.searched(lexical.index(docs, "id", "text", english=False, only=terms), asked, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L, id#", plan)
    assert sorted(map(tuple, found.collect())) == [(q, i, 0.1) for q in range(3) for i in range(1, 40, 2)]


def test_words_of_a_chunk_are_counted_before_queries_join_them(spark):
    """A word that a chunk repeats crosses to the count once, with how often it stands there."""
    asked = pa.array([["p", "q"], ["q"], [], ["p"]], pa.list_(pa.string()))
    for width in (0, 2000):  # close and sparse pairs
        more = [pa.array([str(i)], pa.string()) for i in range(width)]
        t = pa.table({"c": pa.array([1, 1, 2, 2, *range(3, 3 + width)]), "asked": pa.array([*asked.to_pylist(), *(m.to_pylist() for m in more)]), "n": pa.array([3, 4, 9, 5] + [1] * width)})
        got = pa.Table.from_batches(list(retrieval._counted(iter(t.to_batches(max_chunksize=3)), 5))).to_pylist()
        assert {(r["q"], r["c"]): r["tf"] for r in got if r["q"] in "pq"} == {("p", 1): 3, ("q", 1): 7, ("p", 2): 5}
    docs = spark.createDataFrame([(1, "two two, one TWO"), (2, None), (3, ""), (4, " three ")], "id long, text string")
    queries = spark.createDataFrame([(1, ["two", "one"]), (2, ["three", "two"])], "query_id long, terms array<string>")
    arm = retrieval.lexical_arm(docs, queries, "id", "text")
    assert re.search(r"HashAggregate\(keys=\[id#\d+L, term#\d+\], functions=\[count", arm._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in arm.collect()) == [(1, 1, 0.4, 1), (2, 1, 0.3, 1), (2, 4, 0.1, 2)]
