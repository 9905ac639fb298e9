"""Queries over projections, filters, predicates, unions and distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import scalars, text
from threadlens.operators import project as p
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.sources import tables

MARKER_TEXTS = ["of the", "la "]


@query("align_schema", """
SELECT o_custkey AS author, o_orderdate AS created_utc, o_orderkey AS id,
       o_totalprice AS score, o_orderpriority AS subreddit FROM orders""")
def _(spark, d):
    return p.align_schema(
        tables.table(spark, d, "orders"),
        {"o_custkey": "author", "o_orderdate": "created_utc", "o_orderkey": "id",
         "o_totalprice": "score", "o_orderpriority": "subreddit"},
        ["author", "created_utc", "id", "score", "subreddit"],
    )


@query("existing_columns_project", "SELECT role, turn, conv_id FROM conversations")
def _(spark, d):
    return p.existing_columns_project(
        tables.table(spark, d, "conversations"), ["author", "role", "turn", "score", "conv_id"]
    )


_WITH_NULLS = """
  SELECT doc_id, nullif(lang, 'de') AS lang, CASE WHEN n_chars < 0 THEN n_chars END AS score, source
  FROM documents"""


def _with_nulls(spark, d):
    return tables.table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") < 0, F.col("n_chars")).alias("score"),
        "source",
    )


@query("drop_columns_with_nulls", f"""
SELECT 'any' AS how, doc_id, NULL::VARCHAR AS lang, source FROM ({_WITH_NULLS})
UNION ALL SELECT 'all', doc_id, lang, source FROM ({_WITH_NULLS})""")
def _(spark, d):
    df = _with_nulls(spark, d)
    any_ = p.drop_columns_with_nulls(df, "any").withColumn("how", F.lit("any"))
    all_ = p.drop_columns_with_nulls(df, "all").withColumn("how", F.lit("all"))
    return any_.unionByName(all_, allowMissingColumns=True)


@query("drop_null_rows", f"SELECT doc_id, lang, source FROM ({_WITH_NULLS}) WHERE lang IS NOT NULL")
def _(spark, d):
    return p.drop_null_rows(_with_nulls(spark, d).drop("score"), ["lang"])


@query("null_profile", f"""
WITH t AS ({_WITH_NULLS})
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS null_count, count(*) > count(doc_id) AS has_nulls FROM t
UNION ALL SELECT 'lang', count(*) - count(lang), count(*) > count(lang) FROM t
UNION ALL SELECT 'score', count(*) - count(score), count(*) > count(score) FROM t
UNION ALL SELECT 'source', count(*) - count(source), count(*) > count(source) FROM t""")
def _(spark, d):
    return p.null_profile(_with_nulls(spark, d))


@query("filter_invalid_markers_exact", """
SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'Click')""")
def _(spark, d):
    ev = tables.table(spark, d, "events").select("event_id", "event_type")
    return p.filter_invalid_markers_exact(ev, "event_type", ["error", "Click"])


@query("filter_clean_posts", f"""
SELECT doc_id AS id, source AS community FROM documents
WHERE regexp_matches(text, '[^{q.WS}]') AND lower(text) NOT LIKE '%[removed]%'
  AND lower(text) NOT LIKE '%[deleted]%' AND lower(text) NOT LIKE '%of the%'
  AND lower(text) NOT LIKE '%la %'""")
def _(spark, d):
    docs = tables.texts(spark, d)
    return p.filter_clean_posts(docs, "text", lx.INVALID_MARKERS + MARKER_TEXTS).select(
        "id", "community"
    )


@query("flag_removed", """
SELECT doc_id AS id, coalesce(regexp_matches(lower(text), 'of the|la '), false) AS is_removed_deleted,
  coalesce(regexp_matches(lower(text), '\\[removed\\]|\\[deleted\\]'), false) AS flagged_default
FROM documents""")
def _(spark, d):
    docs = p.flag_removed(tables.texts(spark, d), "text", MARKER_TEXTS)
    docs = p.flag_removed(docs, "text", out="flagged_default")
    return docs.select("id", "is_removed_deleted", "flagged_default")


@query("filter_communities", """
SELECT doc_id AS id, source AS community FROM documents WHERE source IN ('src1', 'src7', 'src13')""")
def _(spark, d):
    docs = tables.texts(spark, d).select("id", "community")
    return p.filter_communities(docs, "community", ["src1", "src7", "src13"])


@query("filter_time_range", """
SELECT event_id, epoch_us(ts) // 1000000 AS created_utc FROM events
WHERE epoch_us(ts) // 1000000 BETWEEN 1704412800 AND 1705276799""")
def _(spark, d):
    # The bounds are in the type of the stored column, so that the scan prunes by them.
    start, end = (F.expr(f"TIMESTAMP_NTZ '2024-01-{t}'") for t in ("05 00:00:00", "14 23:59:59.999999"))
    ev = p.filter_time_range(tables.table(spark, d, "events"), "ts", start, end)
    return ev.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_utc"))


@query("filter_recent_window", """
SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 DAY""")
def _(spark, d):
    return p.filter_recent_window(tables.table(spark, d, "events").select("event_id", "ts"), "ts")


@query("filter_min_length", "SELECT doc_id AS id, n_chars FROM documents WHERE length(text) >= 5")
def _(spark, d):
    return p.filter_min_length(tables.texts(spark, d), "text").select("id", "n_chars")


@query("explore_filter", f"""
SELECT id, author, community, word_count FROM (
  SELECT doc_id AS id, source AS author, lang AS community, text,
         len({q.words('text')})::BIGINT AS word_count FROM documents)
WHERE word_count BETWEEN 50 AND 400 AND community IN ('en', 'fr')
  AND (contains(lower(text), 'the |') OR contains(lower(text), '.\nth') OR contains(lower(author), '.\nth')
       OR contains(lower(text), 'pa. '))
  AND contains(lower(text), '. e')""")
def _(spark, d):
    docs = tables.texts(spark, d).select(
        "id", F.col("community").alias("author"), F.col("lang").alias("community"), "text"
    ).withColumn("word_count", F.size(text.words(F.col("text"))).cast("long"))
    parts = [
        p.explore_filter(docs, (50, 400), ["en", "fr"], key) for key in ("THE |", ".\nTh", "pa. ")
    ]
    hits = p.union_by_name(*parts).dropDuplicates(["id"])
    return p.explore_filter(hits, (50, 400), [], ". E").select("id", "author", "community", "word_count")


@query("net_score", "SELECT doc_id, quality - toxic AS score FROM labels")
def _(spark, d):
    return p.net_score(tables.table(spark, d, "labels"), "quality", "toxic").select("doc_id", "score")


@query("tag_constants", """
SELECT item_id, 0 AS label, 'ai' AS source, 'post' AS interaction_type FROM benchmark""")
def _(spark, d):
    items = tables.table(spark, d, "benchmark").select("item_id")
    return p.tag_constants(items, label=0, source="ai", interaction_type="post")


@query("compose_text", """
SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(source, '') AS spaced,
  coalesce(lang, '') || chr(10) || chr(10) || coalesce(source, '') AS stacked
FROM (SELECT doc_id, nullif(lang, 'de') AS lang, source FROM documents)""")
def _(spark, d):
    df = _with_nulls(spark, d)
    return df.select(
        "doc_id",
        text.compose_text(F.col("lang"), F.col("source")).alias("spaced"),
        text.compose_text(F.col("lang"), F.col("source"), "\n\n").alias("stacked"),
    )


@query("canonicalize_values", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'post' ELSE event_type END AS interaction_type,
  CASE user_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'human' ELSE 'Noise (Unclustered)' END AS class_name
FROM events""")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    cluster = F.when(F.col("user_id") % 3 == 2, -1).otherwise(F.col("user_id") % 3)
    names = {**lx.CLASS_NAMES, -1: "Noise (Unclustered)"}
    return ev.select(
        "event_id",
        scalars.map_values(F.col("event_type"), {"signup": "post"}).alias("interaction_type"),
        scalars.map_values(cluster, names, F.lit(None)).alias("class_name"),
    )


@query("is_comment_flag", """
SELECT conv_id, turn, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS is_comment FROM conversations""")
def _(spark, d):
    kind = F.when(F.col("turn") > 0, "comment").otherwise("post")
    turns = tables.table(spark, d, "conversations").withColumn("interaction_type", kind)
    return p.is_comment_flag(turns).select("conv_id", "turn", "is_comment")


@query("union_by_name", """
SELECT doc_id AS id, text, lang FROM documents
UNION ALL SELECT item_id, text, NULL FROM benchmark""")
def _(spark, d):
    docs = tables.texts(spark, d).select("id", "text", "lang")
    items = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return p.union_by_name(docs, items)


@query("distinct_values", "SELECT DISTINCT lang FROM (SELECT nullif(lang, 'de') AS lang FROM documents) WHERE lang IS NOT NULL")
def _(spark, d):
    return p.distinct_values(_with_nulls(spark, d), "lang")


@query("feature_columns", """
SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def _(spark, d):
    df = tables.table(spark, d, "documents").join(tables.table(spark, d, "labels"), "doc_id")
    return df.select(*p.feature_columns(df, for_model=True))
