"""Queries on streams: the tables replayed as streams, with the SQL of their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.files import read_table
from ..streaming import streams as ST
from . import views as V
from .governance_queries import SINKS_SQL
from .session_queries import LOCKOUT_SQL, SECONDS

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def folder(spark) -> str:
    """A fresh folder below the shared one of the session."""
    from ..sources.shared import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark, sf):
    source = spark.readStream.schema(EVENTS)
    s = source.option("pathGlobFilter", "events.parquet").parquet(sf) if _is_file(spark, sf, "events") else source.parquet(f"{sf}/events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def appended(spark, stream, schema):
    """What a stream in append mode has written after all of its table and one row far later, whose watermark closes what is open."""
    return ST.replay(stream, folder(spark), schema)


def closed(spark, sf):
    """events as a stream whose last rows lie a year later, so that every window and session before is closed."""
    last = read_table(spark, sf, "events").agg(F.max("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("max(ts)") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"),
    )
    at = folder(spark)
    last.write.parquet(f"{at}/end")
    later = spark.readStream.schema(EVENTS).parquet(f"{at}/end")
    return events(spark, sf).union(later.withColumn("ts", F.col("ts").cast("timestamp")))


def st2(spark, sf):
    """Counts for each hour and kind of event, appended as the watermark passes."""
    s = ST.windowed_counts(closed(spark, sf), size="1 hour")
    d = appended(spark, s, "start timestamp, event_type string, n long, total double").where("event_type <> 'end'")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def st2_sliding(spark, sf):
    """Counts for five minutes by one, with late rows: copies of the last five minutes, which count, and of what lies half an hour back or more, which is too late."""
    e = read_table(spark, sf, "events")
    end = e.agg(F.max("ts").alias("end"))  # one row
    at = folder(spark)
    e.write.parquet(f"{at}/in/1")
    back = e.crossJoin(F.broadcast(end)).where("ts >= end - INTERVAL 5 MINUTES OR ts < end - INTERVAL 30 MINUTES").drop("end")
    back.withColumn("event_type", F.lit("late")).coalesce(1).write.parquet(f"{at}/in/2")
    last = e.limit(1).crossJoin(F.broadcast(end)).withColumn("ts", F.col("end") + F.expr("INTERVAL 365 DAYS")).withColumn("event_type", F.lit("end")).drop("end")
    last.coalesce(1).write.parquet(f"{at}/in/3")
    # One folder after the other: what a batch finds late depends on those before.
    out, checkpoint = f"{at}/out", f"{at}/checkpoint"
    for upto in ("{1}", "{1,2}", "{1,2,3}"):
        stream = spark.readStream.schema(EVENTS).parquet(f"{at}/in/{upto}").withColumn("ts", F.col("ts").cast("timestamp"))
        counts = ST.windowed_counts(stream, size="5 minutes", slide="1 minute")
        counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    d = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out).where("event_type <> 'end'")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


ST2_SLIDING_SQL = """WITH e AS (SELECT ts, event_type, value FROM events UNION ALL SELECT ts, 'late', value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(unnest(range(0, 5)) AS INT)) AS start FROM e) GROUP BY ALL"""


def st3(spark, sf):
    """Lockouts as a stream with state."""
    s = events(spark, sf).where("event_type IN ('error', 'signup')").select(
        F.col("user_id").cast("string").alias("client_key"), F.col("event_id").alias("attempt_id"), "ts", (F.col("event_type") == "signup").alias("success")
    )
    return appended(spark, ST.lockout_stream(s, seconds=SECONDS), "client_key string, attempt_id long, locked boolean, failures int").select(
        "attempt_id", "locked", F.col("failures").cast("long").alias("failures")
    )


def st3_ordered(spark, sf):
    """The same in the order of time over all batches, each attempt as the watermark passes it."""
    s = closed(spark, sf).where("event_type IN ('error', 'signup', 'end')").select(
        F.col("user_id").cast("string").alias("client_key"), F.col("event_id").alias("attempt_id"), "ts", (F.col("event_type") == "signup").alias("success")
    )
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        d = appended(spark, ST.ordered_lockout_stream(s, seconds=SECONDS), "client_key string, attempt_id long, locked boolean, failures int")
    finally:
        spark.conf.set(name, before)
    return d.where("attempt_id >= 0").select("attempt_id", "locked", F.col("failures").cast("long").alias("failures"))


def st4(spark, sf):
    """Sessions of activity with a gap of half an hour, appended as the watermark passes their end."""
    s = ST.activity_sessions(closed(spark, sf)).select("user_id", "start", "n")
    d = appended(spark, s, "user_id long, start timestamp, n long").where("user_id >= 0")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


ST4_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i"""


def st1(spark, sf):
    """Conversations as a stream of messages, governed as they come; what passed, and how often it was masked."""
    c = read_table(spark, sf, "conversations")
    kind = c.schema
    source = spark.readStream.schema(kind)
    glob = source.option("pathGlobFilter", "conversations.parquet").parquet(sf) if _is_file(spark, sf, "conversations") else source.parquet(f"{sf}/conversations.parquet")
    m = V.marked(glob)
    at = folder(spark)
    ST.govern_stream(m, V.users(spark, sf), f"{at}/out", f"{at}/checkpoint", 2).awaitTermination()
    p = spark.read.parquet(f"{at}/out/passed").select("conv_id", "turn", F.lit("passed").alias("sink"))
    return p.union(spark.read.parquet(f"{at}/out/blocked").select("conv_id", "turn", F.lit("blocked")))


def _is_file(spark, sf: str, table: str) -> bool:
    """Whether the table is one file (streams read folders only): its rows then all come from that path."""
    name = spark.read.parquet(f"{sf}/{table}.parquet").select(F.input_file_name()).first()
    return bool(name) and name[0].rstrip("/").endswith(f"{table}.parquet")


QUERIES = {
    "st1_governed_stream": (st1, SINKS_SQL),
    "st2_windowed_counts": (st2, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "st2_sliding_windows": (st2_sliding, ST2_SLIDING_SQL),
    "st3_lockout_stream": (st3, LOCKOUT_SQL),
    "st3_ordered_lockouts": (st3_ordered, LOCKOUT_SQL),
    "st4_activity_sessions": (st4, ST4_SQL),
}
