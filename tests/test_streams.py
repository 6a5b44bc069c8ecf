"""Stateful streams against their batch twins, over several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitaloom.functions import fixed
from vitaloom.streaming import answers, limits, sinks, sweeps

DAY = dt.datetime(2024, 1, 1)
at = lambda m, s=0: DAY + dt.timedelta(minutes=m, seconds=s)


def run(spark, tmp_path, rows, schema, make, parts=3):
    """``make`` over a stream of ``rows`` in so many micro-batches, one file each."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = make(live)
    sinks.appended(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select(*out.columns)


WORK = "doc long, n long, status string, at timestamp"


def test_sweeper_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 12), n, rng.choice(["processing", "processing", "done", "failed"]), at(0, 37 * n)) for n in range(300)]
    rows += [(None, 900, "processing", rows[-1][3])]
    stream = run(spark, tmp_path, rows, WORK, lambda live: sweeps.stalls_stream(live, "doc", F.col("status"), F.col("at"), "n"))
    batch = sweeps.stalls(spark.createDataFrame(rows, WORK), "doc", F.col("status"), F.col("at"), "n", F.lit(rows[-1][3]))
    assert stream.columns == batch.columns
    got, want = sorted(map(tuple, stream.collect())), sorted(map(tuple, batch.collect()))
    assert got == want and want and {r[3] for r in got} == {fixed.STALL_NOTE}


@pytest.mark.parametrize(("seconds", "stalled"), [(900, False), (901, True)])
def test_the_limit_itself_is_not_too_late(spark, tmp_path, seconds, stalled):
    rows = [(1, 1, "processing", at(0)), (2, 2, "done", at(0, seconds))]  # the second one only moves the clock
    stream = run(spark, tmp_path, rows, WORK, lambda live: sweeps.stalls_stream(live, "doc", F.col("status"), F.col("at"), "n"), parts=2)
    assert stream.count() == int(stalled)
    assert sweeps.stalls(spark.createDataFrame(rows, WORK), "doc", F.col("status"), F.col("at"), "n", F.lit(rows[1][3])).count() == int(stalled)


def test_update_behind_the_limit_tells_the_span_once(spark, tmp_path):
    rows = [(1, 1, "processing", at(0)), (1, 2, "done", at(30)), (1, 3, "processing", at(31)), (1, 4, "processing", at(40)), (9, 5, "done", at(54))]
    stream = run(spark, tmp_path, rows, WORK, lambda live: sweeps.stalls_stream(live, "doc", F.col("status"), F.col("at"), "n"), parts=5)
    assert [(r.doc, r.since, r.failed_at) for r in stream.collect()] == [(1, at(0), at(15))]


ASKED = "owner string, n long, key string, first boolean, at timestamp"


def both(spark, tmp_path, rows, **options):
    say = lambda df, f: f(df, "owner", F.col("at"), "n", F.col("key"), F.col("first"), **options)
    stream = run(spark, tmp_path, rows, ASKED, lambda live: say(live, answers.answered_stream))
    batch = say(spark.createDataFrame(rows, ASKED), answers.answered)
    assert stream.columns == batch.columns
    got, want = ({r.id: (r.hit, r.answered_at) for r in df.collect()} for df in (stream, batch))
    assert got == want
    return want


def test_answers_live_from_the_first(spark, tmp_path):
    rows = [("a", 1, "q", True, at(0)), ("a", 2, "q", True, at(4)), ("a", 3, "q", True, at(5)), ("a", 4, "q", True, at(5, 1)), ("b", 5, "q", True, at(5, 2)), ("a", 6, "q", False, at(6)), ("a", 7, "q", None, at(6, 1)), ("a", 8, "q", True, at(10)), (None, 9, "q", True, at(10))]
    assert both(spark, tmp_path, rows) == {1: (False, at(0)), 2: (True, at(0)), 3: (True, at(0)), 4: (False, at(5, 1)), 5: (False, at(5, 2)), 6: (False, None), 7: (False, None), 8: (True, at(5, 1))}


def test_first_made_answer_goes_first(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), n, f"q{rng.randint(0, 7)}", rng.random() < 0.9, at(0, 20 * n)) for n in range(240)]
    hits = sum(h for h, _ in both(spark, tmp_path, rows, size=4).values())
    free = sum(h for h, _ in both(spark, tmp_path / "more", rows, size=100).values())
    assert 0 < hits < free


def test_limiter_state_goes_after_its_window(spark, tmp_path):
    rows = [(1, n, at(0, 10 * n)) for n in range(20)] + [(2, 50, at(60))]
    schema = "user long, id long, ts timestamp"
    want = {(r.user, r.id, r.accepted, r.retry_after) for r in limits.limited(spark.createDataFrame(rows, schema), ["user"], "ts", "id", 3, 60).collect()}
    stream = run(spark, tmp_path, rows, schema, lambda live: limits.limited_stream(live.withWatermark("ts", "0 seconds"), {"user": "long"}, "ts", "id", 3, 60))
    assert {(r.user, r.id, r.accepted, r.retry_after) for r in stream.collect()} == want
    held = spark.read.format("statestore").option("stateVarName", "window").load(f"{tmp_path}/cp")
    assert [r.key.user for r in held.collect()] == [2]  # the first one's window has passed
