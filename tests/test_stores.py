"""Tables that change together, files of owners, frames through a sink and cut anywhere, entity and embedding backends."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitaloom.functions import fixed
from vitaloom.operators import backends, records
from vitaloom.sources import filestore
from vitaloom.sources.snapshots import Conflict, Snapshots
from vitaloom.streaming import frames, sinks

TABLES = ("chunks", "medications", "diagnoses", "labs", "allergies")


def tables(spark, docs, mark):
    return {t: spark.createDataFrame([(d, f"{t}-{mark}-{d}-{k}") for d in docs for k in range(2)], "doc long, said string") for t in TABLES}


def seen(store):
    return {t: sorted(tuple(r) for r in df.collect()) for t, df in store.read_all().items()}


class Broken(RuntimeError):
    pass


def test_readers_see_all_old_or_all_new(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s", "doc", buckets=4)
    ids = spark.range(6).withColumnRenamed("id", "doc")
    assert store.version() == 0 and store.read_all() == {} and store.replace(tables(spark, range(6), "a"), ids) == 1
    old, some = seen(store), ids.where("doc < 2")
    steps: list[str] = []
    Snapshots(spark, f"{tmp_path}/dry", "doc", 4, before=steps.append).replace(tables(spark, range(6), "a"), ids)
    assert steps == ["write"] * 5 + ["stage", "commit"]
    for k in range(len(steps)):
        left = iter(range(k))

        def kill(step, left=left):
            if next(left, None) is None:
                raise Broken(step)

        broken = Snapshots(spark, f"{tmp_path}/s", "doc", 4, before=kill)
        with pytest.raises(Broken):
            broken.replace(tables(spark, [0, 1], "b"), some)
        assert seen(store) == old and store.version() == 1
    fresh = tables(spark, [0, 1], "b") | {"labs": tables(spark, [], "b")["labs"]}
    assert store.replace(fresh, some) == 2
    want = {t: sorted([r for r in rows if r[0] > 1] + [(d, f"{t}-b-{d}-{k}") for d in (0, 1) for k in range(2) if t != "labs"]) for t, rows in old.items()}
    assert seen(store) == want
    assert sorted(map(tuple, store.read("labs", 1).collect())) == old["labs"]  # an older version is still there
    store.forget(keep=1)
    assert seen(store) == want
    with pytest.raises(LookupError):
        store.read("labs", 1)


def test_writers_from_one_version(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s", "doc", buckets=64)
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "doc long")
    store.replace(tables(spark, range(8), "a"), ids(*range(8)))
    assert store.replace(tables(spark, [1], "b"), ids(1), base=1) == 2
    assert store.replace(tables(spark, [2], "c"), ids(2), base=1) == 3  # other buckets: the change is carried over
    with pytest.raises(Conflict):
        store.replace(tables(spark, [1], "d"), ids(1), base=1)
    marks = {(d, s.split("-")[1]) for d, s in seen(store)["labs"]}
    assert marks == {(d, "b" if d == 1 else "c" if d == 2 else "a") for d in range(8)}

    def race(step):  # another writer commits between this one's staging and its rename
        if step == "commit" and store.version() == 3:
            store.replace(tables(spark, [5], "e"), ids(5))

    assert Snapshots(spark, f"{tmp_path}/s", "doc", 64, before=race).replace(tables(spark, [6], "f"), ids(6)) == 5
    marks = {(d, s.split("-")[1]) for d, s in seen(store)["chunks"]}
    assert {(5, "e"), (6, "f"), (1, "b"), (2, "c"), (0, "a")} <= marks


def test_published_pointer_never_goes(spark, tmp_path):
    records.publish(spark.range(3), f"{tmp_path}/p", "one")
    records.publish(spark.range(5), f"{tmp_path}/p", "two")
    assert records.current(spark, f"{tmp_path}/p").count() == 5
    (tmp_path / "p" / "_pointers" / ".half").write_text("broken")  # a writer that died after staging
    assert records.current(spark, f"{tmp_path}/p").count() == 5


def test_patch_of_null(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, s string, t string")
    patch = spark.createDataFrame([(1, None, True, None), (2, None, False, "new"), (3, "n", True, None)], "id int, s string, s_set boolean, t string")
    assert sorted(map(tuple, records.patched(t, patch, "id", ["s", "t"]).collect())) == [(1, None, "x"), (2, "b", "new"), (3, "n", "z")]


def test_unknown_status_empties_the_extraction(spark):
    made = lambda status: json.dumps({"medications": [{"name": "m"}], "diagnoses": [{"condition": "x", **status}]})
    rows = [(k, made(s)) for k, s in enumerate(({"assertionStatus": "perhaps"}, {"assertionStatus": "absent"}, {}, {"assertionStatus": None}, {"assertionStatus": 7}))]
    got = {r.k: r.n for r in spark.createDataFrame(rows, "k int, raw string").select("k", F.size(records.extraction(F.col("raw"))["medications"]).alias("n")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_files_of_owners(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = [("me", "a.txt", b"1"), ("me", "b c/../d", b"22"), ("../you", ".hidden", b""), ("me", "a.txt", b"1"), ("them", "x" * 300, None)]
    kept = filestore.saved(spark.createDataFrame(rows, "owner string, name string, content binary"), root).select("path").collect()
    assert {r.path for r in kept} == {"me/a.txt", "me/b_c_.._d", "__you/_hidden", "them/" + "x" * 200}
    held = {r.path: (r.owner, r.name, r.length, bytes(r.content)) for r in filestore.files(spark, root).collect()}
    assert held == {"me/a.txt": ("me", "a.txt", 1, b"1"), "me/b_c_.._d": ("me", "b_c_.._d", 2, b"22"), "__you/_hidden": ("__you", "_hidden", 0, b""), "them/" + "x" * 200: ("them", "x" * 200, 0, b"")}
    assert [r.path for r in filestore.files(spark, root, owner="them").collect()] == ["them/" + "x" * 200]
    (tmp_path / "outside").write_text("stays")
    asked = [("me/a.txt",), ("me/none",), ("../outside",), ("/etc/hosts",), ("me//a",), ("",), (None,), ("me\\..\\x",)]
    gone = {r.path: r.gone for r in filestore.deleted(spark.createDataFrame(asked, "path string"), root).collect()}
    assert gone == {p: p == "me/a.txt" for (p,) in asked} and (tmp_path / "outside").exists()
    assert {(r.owner, r.gone) for r in filestore.deleted_owners(spark.createDataFrame([("them",), ("nobody",), (None,)], "owner string"), root).collect()} == {("them", True), ("nobody", False), (None, False)}
    assert {r.owner for r in filestore.files(spark, root).collect()} == {"me", "__you"}
    assert filestore.files(spark, f"{tmp_path}/nothing").count() == 0


def test_files_without_a_record_go_again(spark, tmp_path):
    df = spark.createDataFrame([("me", "a", b"1"), ("me", "b", b"2")], "owner string, name string, content binary")

    def fail(kept):
        assert kept.count() == 2 and filestore.files(spark, f"{tmp_path}/s").count() == 2
        raise Broken("no table")

    with pytest.raises(Broken):
        filestore.saved_with(df, f"{tmp_path}/s", fail)
    assert filestore.files(spark, f"{tmp_path}/s").count() == 0
    filestore.saved_with(df, f"{tmp_path}/s", lambda kept: kept.select("path").write.parquet(f"{tmp_path}/table"))
    assert spark.read.parquet(f"{tmp_path}/table").count() == filestore.files(spark, f"{tmp_path}/s").count() == 2


@pytest.mark.parametrize("owner", ["", None])
def test_a_segment_of_nothing_is_refused(spark, tmp_path, owner):
    with pytest.raises(PySparkException, match="Invalid storage path segment"):
        filestore.saved(spark.createDataFrame([(owner, "a", b"1")], "owner string, name string, content binary"), f"{tmp_path}/s")
    with pytest.raises(PySparkException, match="Invalid storage path"):
        filestore.files(spark, f"{tmp_path}/s", owner="..").count()


def test_safe_paths(spark):
    paths = ["a/b", "a", "", None, "/a", "a//b", "../a", "a/..", "a\\..\\b", "a..b/c"]
    got = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").orderBy("k").select(filestore.is_safe(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False, False, False, True]


PAYLOADS = [{"conversationId": "c1", "sources": [{"documentId": "d"}]}, {"content": "Hello "}, {"content": "wörld – 日本 🎉"}, {"conversationId": "c2", "content": ""}, {"sources": []}, {"content": 7}, {"content": "."}]


def cut(raw, rng, most=9):
    out, at = [], 0
    while at < len(raw):
        n = rng.randint(1, most)
        out.append(raw[at : at + n])
        at += n
    return out


def test_frames_cut_at_any_byte(spark):
    rng = random.Random(1)
    raw = "".join(f"data: {json.dumps(p, ensure_ascii=False)}\n\n" for p in PAYLOADS)
    runs = {1: raw + "data: [DONE]\n\ndata: {\"content\": \"late\"}\n\n", 2: ": note\nevent: x\ndata: {broken\n\ndata: [1]\n\n" + raw, 3: raw[:-2], 4: "", 5: 'data: {"error": "no luck"}\r\n\r\n'}
    rows = [(k, i, b) for k, t in runs.items() for i, b in enumerate(cut(t.encode(), rng))] + [(1, 10**6, None), (None, 0, b"data: {}\n")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i long, content binary").repartition(3)
    got = frames.reassembled(df, "k", "i")
    per = {}
    for r in got.orderBy("k", "place").collect():
        per.setdefault(r.k, []).append(json.loads(r.payload))
    assert per == {1: PAYLOADS, 2: PAYLOADS, 3: PAYLOADS[:-1], 5: [{"error": "no luck"}]}
    said = {r.k: (r.conversation, r.content, r.sources, r.error) for r in frames.answers(got, "k").collect()}
    assert said[1] == said[2] == ("c1", "Hello wörld – 日本 🎉.", "[]", None) and said[3][1] == "Hello wörld – 日本 🎉" and said[5] == (None, "", None, "no luck")


def test_frame_sink_shows_committed_batches_only(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + j,) for j in range(5)], "n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = lambda: spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select(sinks.frame(F.struct("n")).alias("frame"))
    frames.sent(live(), f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "sink" / "frames" / "orphan.sse").write_text('data: {"n": -1}\n\n')  # a task whose batch was never committed
    back = frames.reassembled(frames.received(spark, f"{tmp_path}/sink").withColumn("i", F.lit(0)), "name", "i")
    want = sorted(k * 10 + j for k in range(3) for j in range(5))
    assert sorted(json.loads(r.payload)["n"] for r in back.collect()) == want
    frames.sent(live(), f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()  # nothing new: nothing doubles
    assert frames.received(spark, f"{tmp_path}/sink").count() == 3


def test_abort_removes_what_was_written(tmp_path):
    w = frames.FrameWriter({"path": str(tmp_path)})
    m = w.write(iter([type("Row", (), {"frame": "data: {}\n\n"})]))
    assert (tmp_path / m.name).exists()
    w.abort([m, None], 0)
    assert not (tmp_path / m.name).exists()


def test_entity_backends(spark):
    docs = spark.createDataFrame([(1, "Tab Metformin 500 mg. Paracetamol taken. " + "x" * 1300 + " Headache"), (2, "  "), (3, None), (4, "metformin Metformin")], "id int, text string")
    rules = {(r.id, r.type, r.text, r.score, r.source) for r in backends.entities(docs, "id", "text").collect()}
    both = {(r.id, r.type, r.text, round(r.score, 3), r.source) for r in backends.entities(docs, "id", "text", "capitals").collect()}
    assert rules == {(1, "medication", "Metformin", 0.75, "rules"), (1, "dosage", "500 mg", 1.0, "rules"), (4, "medication", "metformin", 0.4, "rules")}
    # 9 letters: a medication at 0.75, which ties with the rule and stays the rule's; 11 letters are no entity; 8 are a condition
    assert both == {(1, "medication", "Metformin", 0.75, "rules"), (1, "dosage", "500 mg", 1.0, "rules"), (1, "condition", "Headache", 0.667, "model"), (4, "medication", "Metformin", 0.75, "model")}


def test_a_failing_model_leaves_the_rules(spark):
    docs = spark.createDataFrame([(1, "Tab Metformin 500 mg")], "id int, text string")
    assert {r.source for r in backends.entities(docs, "id", "text", "unheard of").collect()} == {"rules"}


def test_model_rows_and_pieces():
    assert backends.model_rows([[{"entity": "B-MEDICATION", "word": " a ", "score": 0.45}, {"entity_group": "Date", "word": "b", "score": 1}, {"entity_group": "Lab_value", "word": "", "score": 1}, {"word": "c", "score": 1}], [{"entity_group": "Sign_symptom", "word": "d", "score": 0.449}]]) == [("a", "medication", 0.45, "model")]
    assert backends.model_pieces("a" * 2500 + "\n\n\n b \n\n ") == ["a" * 1200, "a" * 1200, "a" * 100, "b"] and fixed.MODEL_CHARS == 1200


def test_embedding_batches_and_checks(spark):
    sizes = []

    def model(texts, kind):
        sizes.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    got = backends.checked_embeddings([str(k) for k in range(200)], "query", model, 2)
    assert sizes == [96, 96, 8] and len(got) == 200
    with pytest.raises(ValueError, match="1 embeddings for 2 inputs"):
        backends.checked_embeddings(["a", "b"], "query", lambda t, k: [[1.0]], 1)
    with pytest.raises(ValueError, match="embedding 1 has 1 dimensions, expected 2"):
        backends.checked_embeddings(["a", "b"], "query", lambda t, k: [[1.0, 2.0], [1.0]], 2)
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("word "), F.col("id"))).alias("t"), F.lit(1).alias("extra")).repartition(2)
    rows = {r.id: r for r in backends.embedded(df, "t", "passage").collect()}
    assert len(rows) == 500 and all((r.embedding is None) == (k % 7 == 0) and r.extra == 1 for k, r in rows.items())
    assert [round(x, 5) for x in rows[8].embedding] == [round(x, 5) for x in backends.word_digests(["word 8"], "passage")[0]] != backends.word_digests(["word 8"], "query")[0]
    with pytest.raises(ValueError):
        backends.embedded(df, "t", "document")


def test_a_model_that_returns_too_few_stops_the_job(spark, monkeypatch):
    backends.EMBEDDING_MODELS["tests.short_model:short"] = (None, 2)
    with pytest.raises(PySparkException, match="embeddings for"):
        backends.embedded(spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1), "t", "query", model="tests.short_model:short").collect()


def test_files_of_frames_are_bounded(spark, tmp_path, monkeypatch):
    """A task that has much to write begins new files, and readers get them in pieces."""
    from types import SimpleNamespace

    monkeypatch.setattr(frames, "FILE_BYTES", 100)
    monkeypatch.setattr(frames, "PIECE_BYTES", 7)
    w = frames.FrameWriter({"path": str(tmp_path)})
    said = [f'data: {{"n": {i}}}\n\n' for i in range(50)]
    message = w.write(iter([SimpleNamespace(frame=f) for f in said]))
    assert len(message.names) > 5
    w.commit([message, None], 0)
    files = frames.received(spark, str(tmp_path))
    assert max(len(r.content) for r in files.collect()) < 130
    pieces = frames.in_pieces(files)
    assert max(len(r.content) for r in pieces.collect()) == 7
    assert sorted(r.payload for r in frames.reassembled(pieces, "name", "piece").collect()) == sorted(f[6:-2] for f in said)
    assert w.write(iter([])).names == []
