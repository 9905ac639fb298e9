"""Skew-safe ranking, quantiles and sampling against plain pandas."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens.operators import authors, profile, ranking, sampling


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows; values repeat heavily and have a long tail."""
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcde"), n)),
        "v": np.where(rng.random(n) < 0.5, 1.0, np.exp(rng.normal(0, 4, n))),
    })
    pdf.loc[len(pdf)] = [n, "single", 7.0]
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", [200_000, 2])
def test_exact_quantiles(hot, limit, monkeypatch):
    """A limit of two rows forbids every broadcast hint."""
    plain = ranking.small_side
    monkeypatch.setattr(ranking, "small_side", lambda df, name: plain(df, name, limit))
    pdf, df = hot
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g]["n"] == len(part)
        assert got[g]["q"] == pytest.approx(part["v"].quantile(probs).tolist(), rel=1e-12)
    whole = ranking.exact_quantiles(df, [], "v", [0.5]).collect()
    assert whole[0]["q"][0] == pytest.approx(pdf["v"].median())


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert ranking.exact_quantiles(df, [], "v", [0.5]).first()["q"] == [2.0]


def test_quantile_cap_impute(spark):
    rows = [("train", float(i)) for i in range(100)] + [("train", 1e6), ("train", None), ("test", None), ("test", 5e6)]
    df = spark.createDataFrame(rows, "split string, perplexity double")
    out = profile.quantile_cap_impute(df, "perplexity").toPandas()
    train = pd.Series([r[1] for r in rows if r[0] == "train"], dtype="float64")
    assert out["perplexity"].max() == pytest.approx(train.quantile(0.99))
    assert out["perplexity"].isna().sum() == 0
    assert out[out.split == "test"]["perplexity"].min() == pytest.approx(train.median())
    empty = spark.createDataFrame([("train", None), ("test", 4.0)], "split string, perplexity double")
    kept = {r["split"]: r["perplexity"] for r in profile.quantile_cap_impute(empty, "perplexity").collect()}
    assert kept == {"train": None, "test": 4.0}


def order(pdf, seed=42):
    key = pdf["id"].map(lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())
    return pdf.assign(k=key).sort_values(["k", "id"])


def test_balance_and_split(hot):
    pdf, df = hot
    part, sdf = pdf[pdf.g != "single"], df.filter("g <> 'single'")
    small = part.groupby("g").size().min()
    want = set(order(part).groupby("g").head(small)["id"])
    assert {r["id"] for r in sampling.balance_classes(sdf, "g").collect()} == want
    split = sampling.stratified_split(df, "g").toPandas()
    assert len(split) == len(pdf) and split["id"].is_unique
    for g, s in split.groupby("g"):
        held = -(-len(s) * 30 // 100)
        assert (s.split != "train").sum() == held
        assert (s.split == "test").sum() == -(-held // 2)
    assert sampling.stratified_sample_n(df, "g", {"hot": 10, "a": 10**9}).groupBy("g").count().orderBy(
        "g").collect()[1]["count"] == 10


def test_top_n_ties_and_quota(spark):
    rows = [(i, "x", 5) for i in range(100)] + [(100, "x", 9), (101, "y", 1)]
    df = spark.createDataFrame(rows, "id long, g string, s long")
    top = sampling.top_commented(df, "g", "s", {"x": 3, "y": 5})
    assert {(r["id"]) for r in top.collect()} == {100, 0, 1, 101}
    floor = {r["g"]: (r["sample_size"], r["min_score"], r["target"])
             for r in sampling.engagement_floor(top, "g", "s", {"x": 3, "y": 5}).collect()}
    assert floor == {"x": (3, 5, 3), "y": (1, 1, 5)}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id long, t string")
    assert {r["id"] for r in sampling.dedup_keep_first(df, "t").collect()} == {1, 2, 4}
    assert sampling.duplicate_count(df, "t").first()[0] == 2


def test_position_and_lag_match_plain_window(spark):
    rng = np.random.default_rng(2)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86400, 500), unit="s")
    pdf = pd.DataFrame({"id": np.arange(500), "author": np.where(rng.random(500) < 0.7, "hot", "b"), "timestamp": ts})
    df = spark.createDataFrame(pdf)
    got = authors.inter_post_gap(df).toPandas().set_index("id")["gap_hours"]
    s = pdf.sort_values(["author", "timestamp", "id"])
    want = (s.groupby("author")["timestamp"].diff().dt.total_seconds() / 3600).set_axis(s["id"])
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    placed = ranking.position_in_group(df, ["author"], ["timestamp", "id"], F.to_date("timestamp")).toPandas()
    rank = (s.groupby("author").cumcount() + 1).set_axis(s["id"])
    assert (placed.set_index("id")["position"].sort_index() == rank.sort_index()).all()


def test_author_rules(spark):
    rows = [
        (1, "one", "2024-01-01 00:00:00", "train"), (2, "two", "2024-01-01 00:00:00", "train"),
        (3, "two", "2024-01-01 05:00:00", "train"), (4, "three", "2024-01-01 00:00:00", "train"),
        (5, "three", "2024-01-01 01:00:00", "train"), (6, "three", "2024-01-02 01:00:00", "train"),
        (7, "late", "2024-01-01 00:00:00", "test"), (8, "[deleted]", "2024-01-01 00:00:00", "train"),
        (9, None, "2024-01-01 00:00:00", "train"),
    ]
    df = spark.createDataFrame(rows, "id long, author string, ts string, split string").withColumn(
        "timestamp", F.to_timestamp("ts"))
    stats = authors.inter_post_interval(df)
    got = {r["author"]: (r["inter_post_median"], r["inter_post_std"]) for r in stats.collect()}
    assert got["one"] == (None, 0.0)
    assert got["two"] == (5.0, None)
    assert got["three"][0] == 12.5 and got["three"][1] == pytest.approx(np.std([1, 24], ddof=1))
    assert set(got) == {"one", "two", "three"}
    joined = {r["id"]: r for r in authors.join_train_stats(df, stats, authors.INTERVAL_FEATURES).collect()}
    assert len(joined) == 9
    assert joined[7]["inter_post_median"] == joined[9]["inter_post_median"] == 8.75
    assert joined[1]["inter_post_median"] == 8.75


def test_distribution_tables(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 3.0), (1, 1.0), (1, 2.0), (1, None)], "label int, v double")
    hist = profile.class_histogram(df, "label", "v", bins=2, cap=None).toPandas()
    assert hist[hist.label == 0]["count"].tolist() == [2]
    flat = profile.minmax_class_profile(df.withColumn("c", F.lit(2.0)), "label", ["c", "v"]).toPandas()
    assert set(flat[flat.feature == "c"]["scaled_mean"]) == {0.5}
    corr = profile.correlation_matrix(df.withColumn("w", F.col("v") * 2), ["v", "w"]).toPandas()
    assert corr[corr.feature_a != corr.feature_b]["corr"].tolist() == pytest.approx([1.0, 1.0])


def test_first_n_and_rate(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "a", " "), (4, "a", "y"), (5, "a", "z"), (6, "b", "[removed]")]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    kept = sampling.first_n_clean_per_group(df, "g", "t", "id", 2)
    assert {r["id"] for r in kept.collect()} == {1, 4}
    rate = {r["g"]: (r["processed"], r["kept"]) for r in sampling.collection_rate(df, kept, "g", "id", 2).collect()}
    assert rate == {"a": (4, 2), "b": (1, 0)}
