"""The whole path from unified posts and comments to the feature matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import scalars
from threadlens.functions.text import clean_text
from threadlens.operators import authors, modelfeat, profile, sampling, topics
from threadlens.operators.project import (
    feature_columns, filter_min_length, is_comment_flag, tag_constants, union_by_name,
)
from threadlens.operators.textfeat import add_features
from threadlens.session import materialize


@dataclass
class FeatureMatrix:
    rows: DataFrame
    features: list[str]
    topic_model: topics.TopicModel | None


def merge_sources(agents: DataFrame, humans: DataFrame) -> DataFrame:
    """Both sources in one table with ``text``, ``upvotes``, ``source`` and ``is_comment``."""
    both = union_by_name(tag_constants(agents, source="ai"), tag_constants(humans, source="human"))
    return is_comment_flag(both.withColumnsRenamed({"content": "text", "score": "upvotes"}))


def prepare_corpus(merged: DataFrame, balance: bool = True, min_chars: int = 5, seed: int = 42) -> DataFrame:
    """Balance, clean, drop short texts, deduplicate across classes and split; in this order."""
    df = sampling.balance_classes(merged, seed=seed) if balance else merged
    df = filter_min_length(df, "text", min_chars).withColumn("text_clean", clean_text(F.col("text")))
    unique = sampling.dedup_keep_first(filter_min_length(df, "text_clean", min_chars), "text_clean")
    return sampling.stratified_split(materialize(unique, "unique"), seed=seed)


def build_feature_matrix(
    merged: DataFrame, balance: bool = True, topic_count: int | None = 20, seed: int = 42,
    community: str = "subreddit", **embedding,
) -> FeatureMatrix:
    """All feature families for the merged table; statistics are fit on the training split only.

    The corpus is written once after the split and once with its row-wise features; families that
    aggregate are joined back on ``id``.
    """
    corpus = materialize(prepare_corpus(merged, balance, seed=seed), "corpus")
    df = add_features(corpus, "text_clean").withColumns({
        "upvotes": scalars.coerce_numeric(F.col("upvotes")),
        "timestamp": scalars.parse_mixed_timestamp(F.col("created_utc")),
    })
    df = materialize(df.withColumns(scalars.calendar_features(F.col("timestamp"))), "row-features")
    stats = authors.author_stats(df, "text_clean", community)
    df = authors.join_train_stats(df, stats, authors.AUTHOR_FEATURES)
    intervals = authors.inter_post_interval(df.select("id", "author", "timestamp", "split"))
    df = authors.join_train_stats(df, intervals, authors.INTERVAL_FEATURES)
    texts = corpus.select("id", "split", "text_clean")
    perplexity = profile.quantile_cap_impute(
        materialize(modelfeat.corpus_perplexity(texts, "text_clean"), "perplexity"), "perplexity"
    )
    df = df.join(modelfeat.pos_distribution(texts, "text_clean"), "id").join(
        modelfeat.sentiment_scores(texts, "text_clean"), "id"
    ).join(perplexity.drop("split"), "id")
    if "encoder" not in embedding and "weights" not in embedding:
        embedding["weights"] = modelfeat.slot_weights(texts.filter(F.col("split") == "train"), "text_clean")
    embedded = materialize(modelfeat.embed_texts(texts, "text_clean", **embedding), "embedded")
    model = None
    if topic_count:
        train = embedded.filter(F.col("split") == "train")
        model, _ = topics.fit_topics(train, "text_clean", k=topic_count, seed=seed)
        embedded = model.transform(embedded).drop("topic_similarity")
    df = df.join(embedded.drop("split", "text_clean"), "id")
    return FeatureMatrix(df, feature_columns(df), model)
