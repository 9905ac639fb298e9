"""Classifiers, metrics and feature files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import classify, matrix, metrics, project, sampling
from threadlens.session import fresh_path
from threadlens.sources import files


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, ("hello friend " if i % 2 else "buy now ") + f"word{i}", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    df = df.withColumn("n_chars", F.length("text")).withColumn("signal", F.col("label") * 2.0)
    return sampling.stratified_split(df, "label")


def test_forest_scores_every_nonblank_text(spark, texts):
    forest = classify.fit_forest(texts.filter("split = 'train'"), trees=5, depth=3)
    assert set(forest.features) == {"n_chars", "signal"}
    more = texts.drop("label", "split").unionByName(
        spark.createDataFrame([(999, " ", 1, 0.0)], "id long, text string, n_chars int, signal double"))
    scored = classify.score_batch(more, forest, "text").toPandas()
    assert len(scored) == 120
    assert (scored["prediction"] == scored["id"] % 2).all()
    assert np.allclose(scored["probability_agent"] + scored["probability_human"], 1)
    assert set(scored["band"]) <= {"0-35", "35-65", "65-100"}
    assert len(classify.score_batch(more.drop("signal"), forest, "text").collect()) == 120


def test_text_classifier_learns(texts):
    model, table = classify.fit_text_classifier(texts, "text", penalties=(0.1, 0.01), n_features=256)
    test = model.transform(texts.filter("split = 'test'"))
    assert metrics.binary_metrics(test).first()["accuracy"] > 0.9
    assert table.count() == 2


def test_metrics_with_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.875)
    curve = [(r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert curve == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]
    one = df.filter("label = 1")
    assert metrics.roc_auc(one).first()[0] is None
    report = metrics.classification_report(one.withColumn("prediction", F.lit(0)), [0, 1]).collect()
    assert {r["class"]: r["f1"] for r in report}["1"] == 0.0
    grid = metrics.confusion_matrix(one.withColumn("prediction", F.lit(0)), [0, 1]).orderBy("label").collect()
    assert [tuple(r) for r in grid] == [(0, 0, 0), (1, 2, 0)]


@pytest.mark.parametrize("scores, best, ran", [
    ([0.5, 0.6, 0.6, 0.1, 0.1, 0.1, 0.9], 3, 6), ([0.1, 0.2, 0.3], 3, 3), ([0.9, 0.1], 1, 2),
])
def test_early_stopping(spark, scores, best, ran):
    df = spark.createDataFrame(list(enumerate(scores, 1)), "epoch int, score double")
    out = metrics.select_best_epoch(df).toPandas()
    assert out[out.is_best]["epoch"].tolist() == [best]
    assert out["ran"].sum() == ran


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c string")
    assert project.drop_columns_with_nulls(df, "any").columns == ["a"]
    assert project.drop_columns_with_nulls(df, "all").columns == ["a", "b"]


def test_explore_filter_is_literal(spark):
    df = spark.createDataFrame([(1, "A.b", None, 5, "x"), (2, "axb", "A.B", 9, "y"), (3, None, None, 7, None)],
                               "id int, text string, author string, word_count int, community string")
    hits = project.explore_filter(df, (5, 9), [], "a.B")
    assert {r["id"] for r in hits.collect()} == {1, 2}
    assert {r["id"] for r in project.explore_filter(df, (5, 7), ["x"], None).collect()} == {1}


def test_csv_round_trip_keeps_awkward_text(spark):
    rows = [(1, 'a "q", b\nnext\r\nline', None), (2, "", " padded "), (3, None, "\\N,"), (4, "tab\tend\\", "'")]
    df = spark.createDataFrame(rows, "id int, text string, other string")
    path = files.sink_csv(df, fresh_path(spark, "csv-test"))
    assert [tuple(r) for r in files.scan_csv(spark, path, df.schema).orderBy("id").collect()] == rows


def test_empty_checkpoint_folder(spark):
    path = fresh_path(spark, "empty")
    spark.createDataFrame([], "id int, safe_content string").write.parquet(path)
    assert files.merge_checkpoints(spark, path, "id int, safe_content string").count() == 0
    tagged = files.scan_tagged_paths(spark, {"a": path, "b": path}, "id int")
    assert tagged.columns == ["id", "subreddit"]


def test_feature_matrix_has_all_families(spark):
    names = ["hello there friend", "the machine answered this question", "we think it seems fine. Really!"]
    same = {i: i - 10 if 10 <= i < 20 else i for i in range(80)}
    rows = [
        (f"a{i % 7}" if i % 11 else None, str(1_700_000_000 + i * 500), f"id{i}", str(i), "c" + str(i % 3), i % 2,
         "post" if i % 4 == 0 else "comment", f"{names[j % 3]} number {j} stays here", None)
        for i, j in same.items()
    ]
    cols = ("author string, created_utc string, id string, score string, subreddit string, label int, "
            "interaction_type string, content string, post_id string")
    hub = spark.createDataFrame(rows, cols)
    merged = matrix.merge_sources(hub.filter("label = 0"), hub.filter("label = 1"))
    built = matrix.build_feature_matrix(merged, topic_count=3, dim=16)
    assert len(built.features) == 63
    out = built.rows.toPandas()
    assert out["text_clean"].is_unique and out["id"].is_unique and len(out) == 70
    assert set(out["split"]) == {"train", "val", "test"}
    whole = [f for f in built.features if f not in ("inter_post_std",)]
    assert not out[whole].isna().any().any()
    assert all(len(v) == 16 for v in out["embedding"])
