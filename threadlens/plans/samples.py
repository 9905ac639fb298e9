"""Queries over sampling, deduplication, splits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import text
from threadlens.functions.text import clean_text
from threadlens.operators import sampling as s
from threadlens.operators.textfeat import add_features
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import cleaned
from threadlens.session import materialize
from threadlens.sources import tables

TARGETS = {"1-URGENT": 200, "2-HIGH": 90, "5-LOW": 4_000_000}
_TARGET_SQL = "(VALUES ('1-URGENT', 200), ('2-HIGH', 90), ('5-LOW', 4000000)) AS t(g, target)"
_TOP = f"""
  SELECT o_orderkey AS id, o_orderpriority AS community, o_totalprice AS score, target
  FROM orders JOIN {_TARGET_SQL} ON g = o_orderpriority
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= target"""


def _orders(spark, d):
    return tables.author_orders(spark, d).select("id", "community", "score", "label")


@query("top_n_per_group", f"SELECT id, community, score FROM ({_TOP})")
def _(spark, d):
    return s.top_commented(_orders(spark, d), "community", "score", TARGETS).drop("label")


@query("engagement_floor", f"""
SELECT community, count(*) AS sample_size, min(score) AS min_score, max(target)::BIGINT AS target
FROM ({_TOP}) GROUP BY community""")
def _(spark, d):
    top = s.top_commented(_orders(spark, d), "community", "score", TARGETS)
    return s.engagement_floor(top, "community", "score", TARGETS)


# "error" plays the removed-post marker.
_EVENTS = """
  SELECT event_id AS id, 'u' || (user_id % 7) AS community, event_type AS text FROM events"""
_QUOTAS = {"u0": 100, "u1": 700, "u2": 5_000_000, "u3": 3}


def _quota_sql(case: str) -> str:
    return f"""
  SELECT * FROM (SELECT *, {case} AS quota FROM ({_EVENTS})) WHERE quota > 0 AND text <> 'error'
  QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= quota"""


_CASE = "CASE community " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _QUOTAS.items()) + " ELSE 0 END"


def _events(spark, d):
    return tables.table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("community"),
        F.col("event_type").alias("text"),
    )


@query("first_n_clean_per_group", f"SELECT id, community, text FROM ({_quota_sql('250')})")
def _(spark, d):
    return s.first_n_clean_per_group(_events(spark, d), "community", "text", "id", 250, ["error"])


@query("tiered_quota", f"SELECT id, community, text FROM ({_quota_sql(_CASE)})")
def _(spark, d):
    return s.first_n_clean_per_group(_events(spark, d), "community", "text", "id", _QUOTAS, ["error"])


@query("collection_rate", f"""
WITH kept AS ({_quota_sql('700')}), cut AS (
  SELECT community, count(*) AS kept, max(id) AS last, count(*) >= 700 AS filled FROM kept GROUP BY community
)
SELECT e.community, count(*) AS processed, coalesce(max(kept), 0) AS kept,
  round(coalesce(max(kept), 0) / count(*)::DOUBLE * 100, 6) AS collection_rate
FROM ({_EVENTS}) e LEFT JOIN cut USING (community)
WHERE NOT coalesce(filled, false) OR e.id <= cut.last GROUP BY e.community""")
def _(spark, d):
    ev = _events(spark, d)
    kept = s.first_n_clean_per_group(ev, "community", "text", "id", 700, ["error"])
    rate = s.collection_rate(ev, kept, "community", "id", 700)
    return rate.withColumn("collection_rate", F.round("collection_rate", 6))


_ORDERS = "(SELECT o_orderkey AS id, o_orderpriority AS community, o_orderstatus AS label FROM orders)"


@query("balance_classes", f"""
SELECT id, label FROM {_ORDERS}
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id), id)
  <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))""")
def _(spark, d):
    return s.balance_classes(_orders(spark, d).select("id", "label"))


_SHORT = {"1-URGENT": 1000, "2-HIGH": 50_000_000, "5-LOW": 500}


@query("stratified_sample_n", f"""
SELECT id, community FROM {_ORDERS}
JOIN (VALUES ('1-URGENT', 1000), ('2-HIGH', 50000000), ('5-LOW', 500)) AS t(g, target) ON g = community
QUALIFY row_number() OVER (PARTITION BY community ORDER BY md5('42-' || id), id) <= target""")
def _(spark, d):
    return s.stratified_sample_n(_orders(spark, d).select("id", "community"), "community", _SHORT)


@query("quota_redistribution", """
WITH t AS (
  SELECT g AS community, target::BIGINT AS target, (SELECT count(*) FROM orders WHERE o_orderpriority = g) AS available
  FROM (VALUES ('1-URGENT', 1000), ('2-HIGH', 50000000), ('5-LOW', 500)) AS t(g, target)
), u AS (SELECT *, greatest(target - available, 0) AS shortfall FROM t)
SELECT *, CASE WHEN shortfall > 0 THEN available
  ELSE target + (SELECT coalesce(sum(shortfall) // nullif(count(*) FILTER (shortfall = 0), 0), 0) FROM u) END::BIGINT AS adjusted_target
FROM u""")
def _(spark, d):
    return s.redistribute_quota(_orders(spark, d).select("community"), "community", _SHORT)


@query("dedup_keep_first", f"""
SELECT id, community, md5(t) AS digest FROM (
  SELECT doc_id AS id, source AS community, {q.clean('text')} AS t FROM documents)
QUALIFY row_number() OVER (PARTITION BY t ORDER BY id) = 1""")
def _(spark, d):
    docs = tables.texts(spark, d).select("id", "community", clean_text(F.col("text")).alias("t"))
    kept = s.dedup_keep_first(docs, "t")
    return kept.select("id", "community", F.md5("t").alias("digest"))


@query("duplicate_count", f"""
SELECT (count(*) - count(DISTINCT t))::BIGINT AS duplicates FROM (SELECT {q.clean('text')} AS t FROM documents)""")
def _(spark, d):
    docs = tables.texts(spark, d).select(clean_text(F.col("text")).alias("t"))
    return s.duplicate_count(docs, "t")


@query("stratified_split", f"SELECT id, label, split FROM {q.split_sql(_ORDERS, 'label')}")
def _(spark, d):
    return s.stratified_split(_orders(spark, d).select("id", "label"))


@query("split_distribution", f"""
SELECT split, count(*) FILTER (label = 'F') AS "F", count(*) FILTER (label = 'O') AS "O",
  count(*) FILTER (label = 'P') AS "P", count(*) FILTER (label = 'X') AS "X",
  count(*) FILTER (label IS NULL) AS "null"
FROM {q.split_sql(_ORDERS, 'label')} GROUP BY split""")
def _(spark, d):
    split = s.stratified_split(_orders(spark, d).select("id", "label"))
    return s.split_distribution(split, "label", ["F", "O", "P", "X"])


@query("random_cap_sample", "SELECT doc_id AS id, source AS community FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 120")
def _(spark, d):
    return s.random_cap_sample(tables.texts(spark, d).select("id", "community"), 120)


@query("head_n", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(spark, d):
    ev = tables.table(spark, d, "events").select("event_id", "value")
    return s.head_n(ev, [F.desc("value"), "event_id"], 25)


@query("sort_rows", "SELECT user_id, ts, event_id FROM events ORDER BY user_id, ts, event_id")
def _(spark, d):
    ev = tables.table(spark, d, "events").select("user_id", "ts", "event_id")
    return s.sort_rows(ev, ["user_id", "ts", "event_id"])


@query("corpus_preparation", f"""
WITH {q.BASE}, u AS (
  SELECT id, community, text_clean, ws, ss, lang FROM base
  QUALIFY row_number() OVER (PARTITION BY text_clean ORDER BY id) = 1
), s AS (SELECT * FROM {q.split_sql('u', 'lang')})
SELECT split, lang, count(*) AS n, sum(len(ws))::BIGINT AS words,
  round(avg(len(ws)), 6) AS mean_words FROM s GROUP BY split, lang""")
def _(spark, d):
    """Clean, drop short texts, deduplicate, split, and profile: the steps ahead of all features."""
    unique = materialize(s.dedup_keep_first(cleaned(spark, d), "text_clean"), "unique")
    split = s.stratified_split(unique, "lang")
    words = split.withColumn("n_words", F.size(text.words(F.col("text_clean"))))
    return words.groupBy("split", "lang").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"),
        F.round(F.avg("n_words"), 6).alias("mean_words"),
    )


@query("style_profile", f"""
WITH {q.BASE}, u AS (
  SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY text_clean ORDER BY id) = 1
), f AS (
  SELECT id, w, count(*) AS n FROM (SELECT id, lower(unnest(ws)) AS w FROM u)
  WHERE regexp_matches(w, '^\\p{{L}}+$') GROUP BY id, w
), a AS (
  SELECT id, count(*) / sum(n)::DOUBLE AS ttr, count(*) FILTER (n = 1) / sum(n)::DOUBLE AS hapax
  FROM f GROUP BY id
)
SELECT community, count(*) AS n, round(avg(length(text_clean)), 6) AS char_count,
  round(avg(len(ws)), 6) AS word_count, round(avg(len(ss)), 6) AS sentence_count,
  round(avg(coalesce(ttr, 0)), 6) AS ttr, round(avg(coalesce(hapax, 0)), 6) AS hapax_ratio,
  round(avg({q.count_class('text_clean', q.PUNCT)} / length(text_clean)::DOUBLE), 6) AS punctuation_density
FROM u LEFT JOIN a USING (id) GROUP BY community""")
def style_profile(spark, d):
    """The flagship: cleaned, deduplicated texts with style features, averaged per community."""
    unique = s.dedup_keep_first(cleaned(spark, d), "text_clean")
    names = ["char_count", "word_count", "sentence_count", "ttr", "hapax_ratio", "punctuation_density"]
    feats = add_features(unique, "text_clean", ["length", "vocab", "punctuation"])
    return feats.groupBy("community").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names]
    )
