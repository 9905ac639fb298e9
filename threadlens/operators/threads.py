"""Joins of comments and posts, and the thread tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import compose_text, strip_id_prefix
from threadlens.operators.project import existing_columns_project, union_by_name
from threadlens.operators.ranking import position_in_group, previous_in_group
from threadlens.sources.tables import STREAM_COLUMNS, THREAD_COLUMNS


def with_clean_ids(comments: DataFrame) -> DataFrame:
    """Root and parent ids without their type prefix."""
    return comments.withColumns({
        "clean_link_id": strip_id_prefix(F.col("link_id")),
        "clean_parent_id": strip_id_prefix(F.col("parent_id")),
    })


def reply_depth_flags(comments: DataFrame) -> DataFrame:
    return comments.withColumns({
        "is_direct_reply_to_post": F.startswith("parent_id", F.lit("t3_")),
        "is_reply_to_comment": F.startswith("parent_id", F.lit("t1_")),
    })


def comments_of_selected_posts(
    comments: DataFrame, posts: DataFrame, start=None, end=None, time_col: str = "created_utc"
) -> DataFrame:
    """Comments whose root is among the posts, inside the time bounds; the bounds reach the scan."""
    if start is not None:
        comments = comments.filter(F.col(time_col) >= start)
    if end is not None:
        comments = comments.filter(F.col(time_col) <= end)
    roots = posts.select(F.concat(F.lit("t3_"), F.col("id").cast("string")).alias("link_id"))
    return comments.join(roots, "link_id", "left_semi")


def comments_with_root_post(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Each comment with title, text and author of its root post; comments without one stay.

    A null link never matches a null id, as in SQL.
    """
    roots = posts.select(
        F.col("id").alias("clean_link_id"),
        F.col("title").alias("root_post_title"),
        F.col("selftext").alias("root_post_text"),
        F.col("author").alias("root_post_author"),
    )
    return reply_depth_flags(with_clean_ids(comments)).join(roots, "clean_link_id", "left")


def comment_inherits_community(
    comments: DataFrame, posts: DataFrame, post_id: str = "post_id", community: str = "subreddit"
) -> DataFrame:
    owner = posts.select(F.col("id").alias(post_id), community)
    return comments.join(owner, post_id, "left")


def unify_threads(
    posts: DataFrame, comments: DataFrame, label: int = 1, sort: bool = True
) -> DataFrame:
    """Posts and comments in one schema, each thread together and in time order.

    The sort is a range partition on (root, time, id), so even one huge thread spreads over tasks.
    """
    p = posts.withColumns({
        "interaction_type": F.lit("submission"),
        "content": compose_text(F.col("title"), F.col("selftext"), "\n\n"),
        "clean_parent_id": F.lit(None).cast("string"),
        "clean_root_id": F.col("id"),
        "created_utc_dt": F.col("created_utc"),
    })
    c = comments.withColumns({
        "interaction_type": F.lit("comment"),
        "content": F.coalesce("body", F.lit("")),
        "clean_parent_id": strip_id_prefix(F.col("parent_id")),
        "clean_root_id": strip_id_prefix(F.col("link_id")),
        "created_utc_dt": F.col("created_utc"),
    })
    both = union_by_name(
        existing_columns_project(p, THREAD_COLUMNS), existing_columns_project(c, THREAD_COLUMNS)
    ).withColumn("label", F.lit(label))
    return both.orderBy("clean_root_id", "created_utc_dt", "id") if sort else both


def unify_author_stream(
    posts: DataFrame, comments: DataFrame, label: int = 1, sort: bool = True
) -> DataFrame:
    """Posts and comments in one schema, in the order each author wrote them."""
    p = posts.withColumns({
        "interaction_type": F.lit("post"),
        "text": compose_text(F.col("title"), F.col("selftext")),
        "created_utc_dt": F.col("created_utc"),
    })
    c = comments.withColumns({
        "interaction_type": F.lit("comment"),
        "text": F.coalesce("body", F.lit("")),
        "created_utc_dt": F.col("created_utc"),
    })
    both = union_by_name(
        existing_columns_project(p, STREAM_COLUMNS), existing_columns_project(c, STREAM_COLUMNS)
    ).withColumn("label", F.lit(label))
    return both.orderBy("author", "created_utc_dt", "id") if sort else both


def thread_summary(threads: DataFrame, root: str, author: str, time: str, parent: str) -> DataFrame:
    """Messages, authors, direct replies and time span of every thread."""
    return threads.groupBy(root).agg(
        F.count("*").alias("n_messages"),
        F.countDistinct(author).alias("n_authors"),
        F.count_if(F.col(parent) == F.col(root)).alias("n_direct_replies"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        (F.max(time) - F.min(time)).alias("duration"),
    )


def thread_position(
    threads: DataFrame, root: str, time: str, id_col: str, bucket
) -> DataFrame:
    """Place of each message in its thread and the distance to the message before it."""
    placed = position_in_group(threads, [root], [time, id_col], bucket, "position")
    placed = previous_in_group(placed, [root], [time, id_col], time, bucket, "previous_at")
    return placed.withColumn("gap", F.col(time) - F.col("previous_at"))
