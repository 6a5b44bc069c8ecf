"""Queries that run as streams: the events table is read as a stream of files to its end, and what the stream wrote is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaloom.plans.catalogue import register
from vitaloom.session import fresh_folder
from vitaloom.sources.tables import live_scan, scan
from vitaloom.streaming import answers, limits, sinks, sweeps
from vitaloom.streaming.state import rocks_state


def _finished(spark, stream, name):
    """Run a stream to the end of its input and read the table that it appended to."""
    root = fresh_folder(spark, name)
    with rocks_state(spark):
        sinks.appended(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table").select(*stream.columns)


def _live(spark, sf_dir):
    return live_scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


_AT = "epoch_us(ts)"


def _status():
    return F.when(F.col("event_type") == "click", "processing").otherwise("done")




@register("stalls_streamed", f"""WITH e AS (SELECT user_id, event_type, {_AT} AS t, coalesce(lead({_AT}) OVER (PARTITION BY user_id ORDER BY ts, event_id), (SELECT max({_AT}) // 1000 * 1000 FROM events)) AS until FROM events)
 SELECT user_id, t AS since, t + 3600000000::BIGINT * 24 AS failed_at FROM e WHERE event_type = 'click' AND until > t + 3600000000::BIGINT * 24""")
def stalls_streamed(spark, sf_dir):
    """The sweeper over a stream of updates, each user being a document whose clicks begin to process it; the watermark ends at the last event."""
    out = sweeps.stalls_stream(_live(spark, sf_dir), "user_id", _status(), F.col("ts"), "event_id", minutes=1440)
    return _finished(spark, out, "stalls").select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("failed_at").alias("failed_at"))


@register("stalls_listed", f"""WITH e AS (SELECT user_id, event_type, {_AT} AS t, coalesce(lead({_AT}) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch_us(TIMESTAMP '2024-02-15')) AS until FROM events)
 SELECT user_id, t AS since, t + 900000000::BIGINT AS failed_at FROM e WHERE event_type = 'click' AND until > t + 900000000::BIGINT""")
def stalls_listed(spark, sf_dir):
    """The batch twin with the usual limit."""
    e = scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    found = sweeps.stalls(e, "user_id", _status(), F.col("ts"), "event_id", F.lit("2024-02-15"))
    return found.select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("failed_at").alias("failed_at"))


_ANSWERS_SQL = f"""WITH RECURSIVE e AS (SELECT user_id % 20 AS owner, event_id AS id, event_type AS k, {_AT} AS t, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts, event_id) AS i FROM events WHERE event_id % 5 <> 0),
 f AS (SELECT owner, id, k, t, i, false AS hit, t AS born FROM e WHERE i = 1
 UNION ALL SELECT e.owner, e.id, e.k, e.t, e.i, e.t - f.born <= 3600000000 * 12, CASE WHEN e.t - f.born <= 3600000000 * 12 THEN f.born ELSE e.t END FROM f JOIN e ON e.owner = f.owner AND e.k = f.k AND e.i = f.i + 1)
 SELECT owner, id, t, hit, born AS answered_at FROM f UNION ALL SELECT user_id % 20, event_id, {_AT}, false, NULL FROM events WHERE event_id % 5 = 0"""


def _questions(events):
    return events.withColumns({"owner": F.col("user_id") % 20, "first": F.col("event_id") % 5 != 0})


def _told(df):
    return df.select("owner", "id", F.unix_micros("at").alias("t"), "hit", F.unix_micros("answered_at").alias("answered_at"))


@register("answers_cached", _ANSWERS_SQL)
def answers_cached(spark, sf_dir):
    """Every event asks its owner's question of that type; each fifth is a later turn. Answers live for half a day."""
    q = _questions(scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))
    return _told(answers.answered(q, "owner", F.col("ts"), "event_id", F.col("event_type"), F.col("first"), seconds=43_200))


@register("answers_cached_stream", _ANSWERS_SQL)
def answers_cached_stream(spark, sf_dir):
    q = _questions(_live(spark, sf_dir))
    return _told(_finished(spark, answers.answered_stream(q, "owner", F.col("ts"), "event_id", F.col("event_type"), F.col("first"), seconds=43_200), "answers"))


@register("rate_limit_stream", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT user_id, event_id, t, i, true AS accepted, NULL::BIGINT AS wait, 1::BIGINT AS n, t + 86400000000 AS reset FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, f.reset <= e.t OR f.n < 2, CASE WHEN f.reset > e.t AND f.n >= 2 THEN greatest(1, ceil((f.reset - e.t) / 1000000.0))::BIGINT END, CASE WHEN f.reset <= e.t THEN 1 WHEN f.n >= 2 THEN f.n ELSE f.n + 1 END, CASE WHEN f.reset <= e.t THEN e.t + 86400000000 ELSE f.reset END
 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, t, event_id AS id, accepted, wait AS retry_after FROM f""")
def rate_limit_stream(spark, sf_dir):
    live = _live(spark, sf_dir).withWatermark("ts", "0 seconds")
    return _finished(spark, limits.limited_stream(live, {"user_id": "long"}, "ts", "event_id", 2, 86_400), "limits")
