"""Streaming queries: the events table replayed as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.plans.registry import query
from threadlens.sources import tables
from threadlens.streaming import streams as st


def _stream(spark, d):
    schema = tables.table(spark, d, "events").schema
    events = st.replay(spark, f"{d}/events*.parquet", schema)
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("author"),
        F.col("ts").alias("timestamp"), F.col("event_type").alias("text"),
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("community"), "value",
    )


@query("stream_clean_filter", """
SELECT event_id AS id, event_type AS text FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    clean = st.stream_clean_filter(_stream(spark, d).select("id", "text"), "text", ["error"])
    return st.run_append(clean, "clean-stream")


@query("stream_group_quota", """
SELECT event_id AS id, 'u' || (user_id % 7) AS community FROM events WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) <= 250""")
def _(spark, d):
    clean = st.stream_clean_filter(_stream(spark, d), "text", ["error"]).select("id", "community")
    candidates = st.run_append(st.stream_group_quota(clean, "community", "id", 250), "quota-stream")
    return st.finish_group_quota(candidates, "community", "id", 250)


@query("stream_minute_budget", """
SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS requests,
  sum(floor(value * 1000))::BIGINT AS tokens, sum(floor(value * 1000)) > 100000 AS over_budget
FROM events GROUP BY 1""")
def _(spark, d):
    tokens = F.floor(F.col("value") * 1000).cast("long")
    stream = _stream(spark, d).select("timestamp", tokens.alias("tokens"))
    windows = st.stream_minute_budget(stream, "timestamp", "tokens", 100_000)
    return st.latest_windows(st.run_batches(windows, "budget", "update"))


@query("stream_scan_counters", """
SELECT 'u' || (user_id % 7) AS community, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS clean
FROM events GROUP BY 1""")
def _(spark, d):
    counters = st.stream_scan_counters(_stream(spark, d), "community", "text", ["error"])
    return st.run_batches(counters, "counters", "complete", keep_all=False)


@query("stream_inter_post_gap", """
SELECT event_id AS id, user_id AS author, false AS late,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9, 6)
    AS gap_hours FROM events""")
def _(spark, d):
    gaps = st.stream_inter_post_gap(_stream(spark, d))
    return gaps.select("id", "author", "late", F.round("gap_hours", 6).alias("gap_hours"))
