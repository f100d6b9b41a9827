"""Streaming jobs over ``events``, arriving as several files; results are read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.plans.registry import query
from stageloom.scratch import new_path
from stageloom.sources.sinks import read_current
from stageloom.streaming import jobs as J
from stageloom.streaming.stateful import rocksdb_state
from stageloom.tables import load

# Longer than the span of the events, so that no row is late whatever the file order.
LATE = "60 days"


def event_files(spark, d):
    """The events in three files, and a stream over them that takes one file per batch."""
    events = load(spark, d, "events").drop("props")
    path = new_path(spark, "arrivals")
    events.repartitionByRange(3, "ts").write.parquet(path)
    return J.read_files(spark, path, events.schema, files_per_batch=1)


@query("stream_ingest", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_ingest(spark, d):
    out = new_path(spark, "ingested")
    J.ingest(event_files(spark, d), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query(
    "stream_upsert",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
         ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def stream_upsert(spark, d):
    """Last event per user and type. File order need not be event order; the id decides across batches too."""
    base = new_path(spark, "state")
    stream = event_files(spark, d).select("user_id", "event_type", "event_id", "value")
    J.keep_latest(stream, base, ["user_id", "event_type"], ["event_id"], new_path(spark, "checkpoint"))
    return read_current(spark, base)


@query(
    "stream_usage_windows",
    """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS requests,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events GROUP BY 1, 2""",
)
def stream_usage_windows(spark, d):
    out = new_path(spark, "windows")
    aggs = {"requests": F.count(F.lit(1)), "cost": F.sum(F.col("value").cast("decimal(18,2)"))}
    totals = J.usage_per_window(event_files(spark, d), "ts", ["event_type"], aggs, "1 day", LATE)
    J.write_changes(totals, out, ["window_start", "event_type"], new_path(spark, "checkpoint"))
    return read_current(spark, out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "event_type", "requests", F.col("cost").cast("double").alias("cost"),
    )


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    out = new_path(spark, "first_requests")
    first = J.drop_repeats(event_files(spark, d), "ts", ["user_id", "event_type"], LATE)
    with rocksdb_state(spark):
        J.ingest(first.select("user_id", "event_type"), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS session_start, count(*) AS requests, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost
       FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
         (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS st
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""",
)
def stream_sessions(spark, d):
    out = new_path(spark, "sessions")
    rows = J.sessions(event_files(spark, d), "ts", "user_id", "600 minutes", LATE, "value")
    with rocksdb_state(spark):
        J.write_changes(rows, out, ["user_id", "session_start"], new_path(spark, "checkpoint"), deleted="gone")
    return read_current(spark, out).select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        "requests", F.col("cost").cast("double").alias("cost"),
    )


@query(
    "stream_budget",
    """SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS spent, count(*) AS n FROM events GROUP BY 1""",
)
def stream_budget(spark, d):
    """The highest running total of a user is all it spent, in whatever order files arrive."""
    out = new_path(spark, "budget")
    J.running_budget(event_files(spark, d), out, ["user_id"], ["ts", "event_id"], "value", 5000, new_path(spark, "checkpoint"), late=LATE)
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("running_total").alias("spent"), F.count(F.lit(1)).alias("n"))
