"""Queries over joins, threads, author statistics and posting intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import text
from threadlens.operators import authors, batches, sampling, threads
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import PHRASES, hedging_sql, prepared
from threadlens.session import materialize
from threadlens.sources import tables

POSTS = """posts AS (
  SELECT conv_id::VARCHAR AS id, role AS author, turn AS created_utc, 'c' || (conv_id % 5) AS subreddit,
         NULL::VARCHAR AS title, text AS selftext, length(text)::BIGINT AS score
  FROM conversations WHERE turn = 0)"""
COMMENTS = """comments AS (
  SELECT conv_id || '_' || turn AS id, role AS author, turn AS created_utc, 't3_' || conv_id AS link_id,
         CASE WHEN turn = 1 THEN 't3_' || conv_id ELSE 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
         text AS body, length(text)::BIGINT AS score
  FROM conversations WHERE turn > 0)"""


@query("strip_id_prefix", f"""
WITH {COMMENTS}
SELECT id, replace(link_id, 't3_', '') AS clean_link_id,
  replace(replace(parent_id, 't1_', ''), 't3_', '') AS clean_parent_id FROM comments""")
def _(spark, d):
    c = threads.with_clean_ids(tables.thread_comments(spark, d))
    return c.select("id", "clean_link_id", "clean_parent_id")


@query("reply_depth_flags", f"""
WITH {COMMENTS}
SELECT id, parent_id LIKE 't3#_%' ESCAPE '#' AS is_direct_reply_to_post,
  parent_id LIKE 't1#_%' ESCAPE '#' AS is_reply_to_comment FROM comments""")
def _(spark, d):
    c = threads.reply_depth_flags(tables.thread_comments(spark, d))
    return c.select("id", "is_direct_reply_to_post", "is_reply_to_comment")


@query("comments_of_selected_posts", f"""
WITH {POSTS}, {COMMENTS}, top AS (
  SELECT id FROM posts QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) <= 10)
SELECT c.id, c.link_id, c.author FROM comments c
WHERE replace(link_id, 't3_', '') IN (SELECT id FROM top) AND created_utc BETWEEN 1 AND 5""")
def _(spark, d):
    posts = sampling.top_commented(tables.thread_posts(spark, d), "subreddit", "score", 10)
    hits = threads.comments_of_selected_posts(tables.thread_comments(spark, d), posts, 1, 5)
    return hits.select("id", "link_id", "author")


@query("comments_with_root_post", f"""
WITH {POSTS}, {COMMENTS}
SELECT c.id, c.author, c.body, c.parent_id LIKE 't1#_%' ESCAPE '#' AS is_reply_to_comment,
  p.title AS root_post_title, p.selftext AS root_post_text, p.author AS root_post_author
FROM comments c LEFT JOIN posts p ON replace(c.link_id, 't3_', '') = p.id""")
def _(spark, d):
    posts = tables.thread_posts(spark, d)
    joined = threads.comments_with_root_post(tables.thread_comments(spark, d), posts)
    return joined.select(
        "id", "author", "body", "is_reply_to_comment", "root_post_title", "root_post_text",
        "root_post_author",
    )


@query("comment_inherits_community", """
SELECT l_orderkey AS post_id, l_linenumber AS line, o_orderpriority AS subreddit
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    lines = tables.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("line")
    )
    posts = tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subreddit")
    )
    return threads.comment_inherits_community(lines, posts)


_THREADS = f"""{POSTS}, {COMMENTS}, threads AS (
  SELECT 'submission' AS interaction_type, subreddit, id, NULL::VARCHAR AS clean_parent_id,
    id AS clean_root_id, author, created_utc AS created_utc_dt,
    coalesce(title, '') || chr(10) || chr(10) || coalesce(selftext, '') AS content, score, 1 AS label FROM posts
  UNION ALL
  SELECT 'comment', NULL, id, replace(replace(parent_id, 't1_', ''), 't3_', ''),
    replace(link_id, 't3_', ''), author, created_utc, body, score, 1 FROM comments)"""


def _threads(spark, d, sort=False):
    return threads.unify_threads(
        tables.thread_posts(spark, d), tables.thread_comments(spark, d), sort=sort
    )


@query("unify_threads", f"WITH {_THREADS} SELECT * FROM threads ORDER BY clean_root_id, created_utc_dt")
def _(spark, d):
    return _threads(spark, d, sort=True)


@query("unify_author_stream", f"""
WITH {POSTS}, {COMMENTS}
SELECT author, created_utc AS created_utc_dt, subreddit, 'post' AS interaction_type,
  coalesce(title, '') || ' ' || coalesce(selftext, '') AS text, score, id, 1 AS label FROM posts
UNION ALL SELECT author, created_utc, NULL, 'comment', body, score, id, 1 FROM comments""")
def _(spark, d):
    return threads.unify_author_stream(tables.thread_posts(spark, d), tables.thread_comments(spark, d))


@query("thread_summary", f"""
WITH {_THREADS}
SELECT clean_root_id, count(*) AS n_messages, count(DISTINCT author) AS n_authors,
  count(*) FILTER (clean_parent_id = clean_root_id) AS n_direct_replies,
  min(created_utc_dt) AS first_at, max(created_utc_dt) AS last_at,
  max(created_utc_dt) - min(created_utc_dt) AS duration
FROM threads GROUP BY clean_root_id""")
def _(spark, d):
    return threads.thread_summary(
        _threads(spark, d), "clean_root_id", "author", "created_utc_dt", "clean_parent_id"
    )


@query("thread_position", f"""
WITH {_THREADS}
SELECT id, row_number() OVER w AS position, lag(created_utc_dt) OVER w AS previous_at,
  created_utc_dt - lag(created_utc_dt) OVER w AS gap
FROM threads WINDOW w AS (PARTITION BY clean_root_id ORDER BY created_utc_dt, id)""")
def _(spark, d):
    bucket = F.floor(F.col("created_utc_dt") / 4)
    placed = threads.thread_position(
        _threads(spark, d), "clean_root_id", "created_utc_dt", "id", bucket
    )
    return placed.select("id", "position", "previous_at", "gap")


# Documents as posts of twenty authors.
_DOC_POSTS = f"""{q.BASE}, posts AS (
  SELECT id, community AS author, lang AS label, lang AS community, text_clean AS text,
         len(ws) AS word_count, length(text_clean)::DOUBLE AS upvotes,
         {hedging_sql('text_clean', 'len(ws)', PHRASES)} AS hedging_per_100w FROM base
), s AS (SELECT * FROM {q.split_sql('posts', 'label')})"""


@query("author_stats", f"""
WITH {_DOC_POSTS}
SELECT author, count(text) AS author_post_count, round(avg(word_count), 6) AS author_mean_word_count,
  round(coalesce(stddev_samp(word_count), 0), 6) AS author_std_word_count,
  round(avg(upvotes), 6) AS author_mean_upvotes,
  count(DISTINCT community) AS author_community_diversity,
  round(avg(hedging_per_100w), 6) AS author_mean_hedging
FROM s WHERE split = 'train' GROUP BY author""")
def _(spark, d):
    t = F.col("text_clean")
    posts = prepared(spark, d).select(
        "id", F.col("community").alias("author"), F.col("lang").alias("label"),
        F.col("lang").alias("community"), t.alias("text"), F.length(t).cast("double").alias("upvotes"),
        F.size(text.words(t)).alias("word_count"), F.lower(t).alias("low"),
    )
    rate = text.hedging_rate(F.col("low"), F.col("word_count"), PHRASES)
    posts = posts.withColumn("hedging_per_100w", rate).drop("low")
    stats = authors.author_stats(sampling.stratified_split(posts, "label"))
    return _rounded(stats)


def _rounded(df, digits: int = 6):
    return df.select(*[
        F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


# Orders as posts of many authors, some of whom only post outside the training split.
_ORDER_POSTS = """posts AS (
  SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS timestamp, o_orderpriority AS community,
         o_orderstatus AS label, o_orderpriority AS text, o_totalprice AS upvotes,
         floor(o_totalprice / 1000)::BIGINT AS word_count, o_totalprice / 1e5 AS hedging_per_100w FROM orders
), s AS (SELECT * FROM """ + q.split_sql("posts", "label") + "), train AS (SELECT * FROM s WHERE split = 'train')"
_ORDER_STATS = """stats AS (
  SELECT author, count(text) AS author_post_count, avg(word_count) AS author_mean_word_count,
    coalesce(stddev_samp(word_count), 0) AS author_std_word_count, avg(upvotes) AS author_mean_upvotes,
    count(DISTINCT community) AS author_community_diversity, avg(hedging_per_100w) AS author_mean_hedging
  FROM train GROUP BY author)"""


def _order_posts(spark, d):
    posts = tables.author_orders(spark, d).select(
        "id", "author", "timestamp", "community", "label", F.col("community").alias("text"),
        F.col("score").alias("upvotes"), F.floor(F.col("score") / 1000).alias("word_count"),
        (F.col("score") / 1e5).alias("hedging_per_100w"),
    )
    return sampling.stratified_split(posts, "label")


@query("join_author_stats", f"""
WITH {_ORDER_POSTS}, {_ORDER_STATS}
SELECT s.id, s.split, """ + ", ".join(
    f"round(coalesce(t.{f}::DOUBLE, (SELECT quantile_cont({f}::DOUBLE, 0.5) FROM stats)), 5) AS {f}"
    for f in authors.AUTHOR_FEATURES
) + " FROM s LEFT JOIN stats t USING (author)")
def _(spark, d):
    posts = _order_posts(spark, d)
    joined = authors.join_train_stats(posts, authors.author_stats(posts), authors.AUTHOR_FEATURES)
    return _rounded(joined.select("id", "split", *authors.AUTHOR_FEATURES), 5)


@query("train_median_impute", f"""
WITH {_ORDER_POSTS}, {_ORDER_STATS}
""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(quantile_cont({f}::DOUBLE, 0.5), 6) AS median FROM stats"
    for f in authors.AUTHOR_FEATURES
))
def _(spark, d):
    stats = materialize(authors.author_stats(_order_posts(spark, d)), "author-stats")
    return _rounded(authors.train_medians(stats, authors.AUTHOR_FEATURES))


@query("inter_post_gap", """
SELECT event_id AS id, user_id AS author,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9, 6)
    AS gap_hours FROM events""")
def _(spark, d):
    gaps = authors.inter_post_gap(tables.author_events(spark, d))
    return gaps.select("id", "author", F.round("gap_hours", 6).alias("gap_hours"))


_GAPS = """gaps AS (
  SELECT author, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY author ORDER BY timestamp, id)))
    / 3.6e9 AS g FROM train
), iv AS (
  SELECT author, quantile_cont(g, 0.5) AS inter_post_median,
    CASE WHEN count(*) > 1 THEN stddev_samp(g) ELSE 0 END AS inter_post_std FROM gaps GROUP BY author)"""


@query("inter_post_interval", f"""
WITH {_ORDER_POSTS}, {_GAPS}
SELECT author, round(inter_post_median, 5) AS inter_post_median, round(inter_post_std, 5) AS inter_post_std FROM iv""")
def _(spark, d):
    return _rounded(authors.inter_post_interval(_order_posts(spark, d)), 5)


@query("join_inter_post_interval", f"""
WITH {_ORDER_POSTS}, {_GAPS}
SELECT s.id, """ + ", ".join(
    f"round(coalesce(iv.{f}, (SELECT quantile_cont({f}, 0.5) FROM iv)), 5) AS {f}"
    for f in authors.INTERVAL_FEATURES
) + " FROM s LEFT JOIN iv USING (author)")
def _(spark, d):
    posts = _order_posts(spark, d)
    stats = authors.inter_post_interval(posts)
    joined = authors.join_train_stats(posts, stats, authors.INTERVAL_FEATURES)
    return _rounded(joined.select("id", *authors.INTERVAL_FEATURES), 5)


@query("cluster_size", """
SELECT vec_id AS id, label AS cluster_id, count(*) OVER (PARTITION BY label) AS cluster_size FROM embeddings""")
def _(spark, d):
    v = tables.vectors(spark, d).select("id", F.col("label").alias("cluster_id"))
    return authors.cluster_size(v)


@query("token_budget_batches", f"""
WITH RECURSIVE t AS (
  SELECT doc_id AS id, doc_id // 250 AS shard, len({q.words('text')})::BIGINT AS tk,
    row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) AS rn FROM documents
), r AS (
  SELECT id, shard, rn, tk, 0 AS batch_no, tk AS used, 1 AS n FROM t WHERE rn = 1
  UNION ALL
  SELECT t.id, t.shard, t.rn, t.tk, CASE WHEN used + t.tk > 5000 OR n >= 20 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN used + t.tk > 5000 OR n >= 20 THEN t.tk ELSE used + t.tk END,
    CASE WHEN used + t.tk > 5000 OR n >= 20 THEN 1 ELSE n + 1 END
  FROM r JOIN t ON t.shard = r.shard AND t.rn = r.rn + 1
)
SELECT id, shard, tk AS n_tokens, batch_no FROM r""")
def _(spark, d):
    docs = tables.texts(spark, d).select(
        "id", F.size(text.words(F.col("text"))).cast("long").alias("n_tokens")
    )
    return batches.token_budget_batches(
        docs, "n_tokens", "id", F.floor(F.col("id") / 250), 5000, 20
    )
