"""Schemas of the logical tables and adapters from the test tables to their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBMISSIONS = (
    "id string, author string, created_utc long, subreddit string, title string, selftext string, "
    "score long, num_comments long"
)
COMMENTS = (
    "id string, author string, created_utc long, link_id string, parent_id string, body string, "
    "score long"
)
AGENT_POSTS = (
    "id string, author_name string, created_at string, submolt_name string, "
    "submolt_display_name string, title string, content string, upvotes long, downvotes long, "
    "comment_count long"
)
AGENT_COMMENTS = (
    "id string, post_id string, author_name string, created_at string, content string, "
    "upvotes long, downvotes long"
)
HUB_COLUMNS = [
    "author", "created_utc", "id", "score", "subreddit", "label", "interaction_type", "content",
    "post_id",
]
THREAD_COLUMNS = [
    "interaction_type", "subreddit", "id", "clean_parent_id", "clean_root_id", "author",
    "created_utc_dt", "content", "score",
]
STREAM_COLUMNS = ["author", "created_utc_dt", "subreddit", "interaction_type", "text", "score", "id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the text role: id, text, community, language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("community"), "lang", "n_chars"
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that carry a 0/1 class label."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic"
    )
    return texts(spark, sf_dir).join(labels, "id")


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of each conversation as a post."""
    turns = table(spark, sf_dir, "conversations")
    return turns.filter(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("role").alias("author"),
        F.col("turn").alias("created_utc"),
        F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("subreddit"),
        F.lit(None).cast("string").alias("title"),
        F.col("text").alias("selftext"),
        F.length("text").cast("long").alias("score"),
    )


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns as comments; the second answers the post, the others the turn before them."""
    turns = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    return turns.filter(F.col("turn") > 0).select(
        F.concat(conv, F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("author"),
        F.col("turn").alias("created_utc"),
        F.concat(F.lit("t3_"), conv).alias("link_id"),
        F.when(F.col("turn") == 1, F.concat(F.lit("t3_"), conv))
        .otherwise(F.concat(F.lit("t1_"), conv, F.lit("_"), (F.col("turn") - 1).cast("string")))
        .alias("parent_id"),
        F.col("text").alias("body"),
        F.length("text").cast("long").alias("score"),
    )


def author_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts of an author in a community."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("author"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("community"),
        F.col("value").alias("score"),
    )


def author_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: many authors with few posts each, and three classes by status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("community"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderstatus").alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
