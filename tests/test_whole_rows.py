"""No operator loses rows over null keys, restarting ordinals or marker texts."""

from pyspark.sql import functions as F

from threadlens.operators import ranking, sampling
from threadlens.sources.files import merge_checkpoints, scan_csv, sink_csv


def test_null_labels_are_a_stratum(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 80, F.col("id") % 2).alias("label"))
    split = sampling.stratified_split(df)
    assert split.count() == 100
    counts = {r["split"]: r["count"] for r in split.filter("label IS NULL").groupBy("split").count().collect()}
    assert counts == {"train": 14, "val": 3, "test": 3}


def test_null_keys_and_times_stay(spark):
    rows = [(1, "a", 10), (2, "a", None), (3, None, 5), (4, None, 9), (5, "a", 30)]
    df = spark.createDataFrame(rows, "id int, author string, t int")
    bucket = F.floor(F.col("t") / 20)
    prev = {r["id"]: r["p"] for r in ranking.previous_in_group(df, ["author"], ["t", "id"], "t", bucket, "p").collect()}
    assert prev == {1: None, 2: None, 3: None, 4: 5, 5: 10}
    place = {r["id"]: r["position"] for r in ranking.position_in_group(df, ["author"], ["t", "id"], bucket).collect()}
    assert place == {2: 1, 1: 2, 5: 3, 3: 1, 4: 2}


def test_ordinals_may_restart(spark):
    rows = [("a", 1, "[removed]"), ("a", 2, "fine"), ("a", 3, "more"), ("b", 1, "good"), ("b", 2, "[deleted]")]
    df = spark.createDataFrame(rows, "community string, ordinal int, text string")
    first = sampling.first_n_clean_per_group(df, "community", "text", "ordinal", 1)
    assert {tuple(r) for r in first.collect()} == {("a", 2, "fine"), ("b", 1, "good")}


def test_csv_keeps_backslashes(spark, tmp_path):
    texts = ["\\N", "\\", "\\\\N", "plain", "", None, "a\\nb\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = sink_csv(df, str(tmp_path / "out"))
    assert {r["id"]: r["text"] for r in scan_csv(spark, path, df.schema).collect()} == dict(enumerate(texts))


def test_missing_checkpoint_folder_is_empty(spark, tmp_path):
    merged = merge_checkpoints(spark, str(tmp_path / "absent"), "id long, text string, safe_content string")
    assert merged.columns == ["id", "text"] and merged.count() == 0
