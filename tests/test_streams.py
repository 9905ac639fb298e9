"""Streams over several micro-batches must give the batch result."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import authors
from threadlens.plans.registry import load
from threadlens.session import fresh_path
from threadlens.streaming import streams as st


@pytest.fixture(scope="module")
def folder(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("author"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("text"), F.lit("all").alias("community"))
    path = fresh_path(spark, "stream-input")
    for lo, hi in ((1, 10), (10, 20), (20, 32)):
        part = events.filter(F.dayofmonth("timestamp").between(lo, hi - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events


def test_gaps_over_batches(spark, folder):
    path, events = folder
    got = st.stream_inter_post_gap(st.replay(spark, path, events.schema)).toPandas().set_index("id")
    want = authors.inter_post_gap(events).toPandas().set_index("id")
    assert len(got) == len(want) and not got["late"].any()
    assert (got["gap_hours"].sort_index().fillna(-1) - want["gap_hours"].sort_index().fillna(-1)).abs().max() < 1e-9


def test_late_rows_correct_their_successor(spark):
    path, schema = fresh_path(spark, "late"), "author long, timestamp timestamp, id long"
    day = datetime.datetime(2024, 1, 1)
    for rows in ([(1, day, 1), (1, day + datetime.timedelta(hours=5), 2)],
                 [(1, day + datetime.timedelta(hours=2), 3), (1, day + datetime.timedelta(hours=6), 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = st.replay(spark, path, spark.createDataFrame([], schema).schema)
    got = {r["id"]: (r["late"], r["gap_hours"]) for r in st.stream_inter_post_gap(stream).collect()}
    assert got == {1: (False, None), 2: (False, 3.0), 3: (True, 2.0), 4: (False, 1.0)}


def test_gaps_of_shuffled_files_equal_the_batch(spark):
    path, schema, rng = fresh_path(spark, "shuffled"), "author long, timestamp timestamp, id long", random.Random(2)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice((1, 2, 3, None)), day + datetime.timedelta(hours=rng.randrange(300)), i) for i in range(150)]
    rows += [(1, None, 900), (1, None, 901), (None, None, 902), rows[3], rows[3]]
    rng.shuffle(rows)
    for at in range(0, len(rows), 31):
        spark.createDataFrame(rows[at:at + 31], schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, schema)
    got = st.stream_inter_post_gap(st.replay(spark, path, whole.schema))
    want = authors.inter_post_gap(whole)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.filter("late").count() > 30


def test_quota_over_batches(spark, folder):
    path, events = folder
    stream = st.replay(spark, path, events.schema).select("id", "community")
    candidates = st.run_append(st.stream_group_quota(stream, "community", "id", 40, salts=4), "quota-test")
    assert 40 <= candidates.count() <= 160
    kept = st.finish_group_quota(candidates, "community", "id", 40)
    first = events.orderBy("id").limit(40)
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in first.collect()}


def test_counters_and_windows_over_batches(spark, folder):
    path, events = folder
    counters = st.stream_scan_counters(st.replay(spark, path, events.schema), "text", "text", ["error"])
    rows = st.run_batches(counters, "counter-test", "complete", keep_all=False).collect()
    assert sum(r["processed"] for r in rows) == events.count()
    assert {r["text"] for r in rows if r["clean"] == 0} == {"error"}
    tokens = st.replay(spark, path, events.schema).select("timestamp", F.length("text").alias("tokens"))
    windows = st.latest_windows(st.run_batches(
        st.stream_minute_budget(tokens, "timestamp", "tokens", 6), "window-test", "update"))
    want = events.groupBy(F.date_trunc("minute", "timestamp").alias("m")).agg(F.sum(F.length("text")).alias("t"))
    assert windows.count() == want.count()
    assert windows.filter("over_budget").count() == want.filter("t > 6").count()


def test_files_out_of_order_give_the_batch_result(spark):
    path, start = fresh_path(spark, "disorder"), datetime.datetime(2024, 1, 1)
    schema = "id long, community string, timestamp timestamp, tokens long"
    for lo in (40, 0, 20):
        rows = [(i, "c", start + datetime.timedelta(minutes=i), i) for i in range(lo, lo + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = st.replay(spark, path, spark.createDataFrame([], schema).schema)
    quota = st.stream_group_quota(stream.select("id", "community"), "community", "id", 5, salts=2)
    kept = st.finish_group_quota(st.run_append(quota, "disorder-quota"), "community", "id", 5)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    budget = st.stream_minute_budget(stream.select("timestamp", "tokens"), "timestamp", "tokens", 30)
    windows = st.latest_windows(st.run_batches(budget, "disorder-budget", "update")).collect()
    assert len(windows) == 60 and sum(r["tokens"] for r in windows) == sum(range(60))


def test_queries_read_a_folder_of_part_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    run = load()["stream_scan_counters"].run
    assert sum(r["processed"] for r in run(spark, str(tmp_path)).collect()) == events.count()
