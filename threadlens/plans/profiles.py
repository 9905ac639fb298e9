"""Queries over counts, group statistics and distributions."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from threadlens.functions import text
from threadlens.operators import profile, sampling
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import cleaned
from threadlens.plans.threads import _rounded
from threadlens.sources import tables


@query("value_counts", """
SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY 2 DESC, 1""")
def _(spark, d):
    return profile.value_counts(tables.table(spark, d, "events"), "event_type")


@query("group_size", "SELECT source AS community, count(*) AS clean_posts_count FROM documents GROUP BY source")
def _(spark, d):
    return profile.group_size(tables.texts(spark, d), "community", "clean_posts_count")


@query("removed_summary", """
SELECT source AS community, count(t) AS total_posts,
  count(*) FILTER (contains(lower(t), 'of the') OR contains(lower(t), 'la ')) AS removed_deleted_count,
  printf('%.2f%%', count(*) FILTER (contains(lower(t), 'of the') OR contains(lower(t), 'la ')) / count(*)::DOUBLE * 100)
    AS removed_deleted_percentage
FROM (SELECT source, CASE WHEN lang <> 'de' THEN text END AS t FROM documents) GROUP BY source""")
def _(spark, d):
    docs = tables.texts(spark, d).select(
        "community", F.when(F.col("lang") != "de", F.col("text")).alias("text")
    )
    return profile.removed_summary(docs, "community", "text", markers=["of the", "la "])


_FEATS = ["char_count", "word_count", "punctuation_density"]
_DOC_FEATS = f"""{q.BASE}, feats AS (
  SELECT id, community, lang, length(text_clean)::BIGINT AS char_count, len(ws)::BIGINT AS word_count,
    {q.count_class('text_clean', q.PUNCT)} / length(text_clean)::DOUBLE AS punctuation_density FROM base)"""


def _doc_feats(spark, d):
    c = F.col("text_clean")
    return cleaned(spark, d).select(
        "id", "community", "lang", F.length(c).cast("long").alias("char_count"),
        F.size(text.words(c)).cast("long").alias("word_count"),
        text.punctuation_density(c).alias("punctuation_density"),
    )


@query("group_feature_means", f"""
WITH {_DOC_FEATS}
SELECT community, lang, {", ".join(f"round(avg({f}), 6) AS {f}" for f in _FEATS)}
FROM feats GROUP BY community, lang""")
def _(spark, d):
    return _rounded(profile.group_feature_means(_doc_feats(spark, d), ["community", "lang"], _FEATS))


def _describe_sql(table: str, group: str, feature: str, keep: str | None = None) -> str:
    return f"""SELECT {keep or group}, '{feature}' AS feature, count({feature}) AS count,
  round(avg({feature}), 5) AS mean, round(stddev_samp({feature}), 5) AS std,
  min({feature})::DOUBLE AS min, max({feature})::DOUBLE AS max,
  round(quantile_cont({feature}::DOUBLE, 0.25), 5) AS p25, round(quantile_cont({feature}::DOUBLE, 0.5), 5) AS p50,
  round(quantile_cont({feature}::DOUBLE, 0.75), 5) AS p75 FROM {table} GROUP BY {group}"""


@query("group_describe", f"""
WITH {q.BASE}, feats AS (
  SELECT community, length(text_clean) AS char_count, len(ws) AS word_count FROM base)
{_describe_sql('feats', 'community', 'char_count')}
UNION ALL {_describe_sql('feats', 'community', 'word_count')}""")
def _(spark, d):
    feats = _doc_feats(spark, d).select("community", "char_count", "word_count")
    return _rounded(
        profile.group_describe(feats, ["community"], ["char_count", "word_count"], cut=True), 5
    )


@query("post_time_profile", "WITH e AS (SELECT event_type AS source, hour(ts) AS hour_of_day FROM events) "
       + _describe_sql("e", "source", "hour_of_day"))
def _(spark, d):
    ev = tables.table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.hour("ts").alias("hour_of_day")
    )
    return _rounded(profile.group_describe(ev, ["source"], ["hour_of_day"]), 5)


_LABELLED = f"""{_DOC_FEATS}, lab AS (
  SELECT f.*, quality AS label, toxic FROM feats f JOIN labels ON doc_id = id)"""


def _labelled(spark, d):
    lab = tables.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic"
    )
    return _doc_feats(spark, d).join(lab, "id")


@query("class_feature_ratio", f"WITH {_LABELLED}" + " UNION ALL ".join(f"""
SELECT '{f}' AS feature, round(avg({f}) FILTER (label = 0), 6) AS mean_0,
  round(avg({f}) FILTER (label = 1), 6) AS mean_1,
  round(avg({f}) FILTER (label = 1) / (avg({f}) FILTER (label = 0) + 1e-10), 6) AS ratio FROM lab""" for f in _FEATS))
def _(spark, d):
    return _rounded(profile.class_feature_ratio(_labelled(spark, d), _FEATS))


@query("quantile_cap_impute", """
WITH posts AS (
  SELECT event_id AS id, event_type AS label, CASE WHEN event_type <> 'error' THEN value END AS perplexity FROM events
), s AS (SELECT * FROM """ + q.split_sql("posts", "label") + """), k AS (
  SELECT quantile_cont(perplexity, 0.99) AS cap, quantile_cont(perplexity, 0.5) AS med FROM s WHERE split = 'train')
SELECT id, split, round(CASE WHEN perplexity IS NULL THEN med ELSE least(perplexity, cap) END, 6) AS perplexity
FROM s CROSS JOIN k""")
def _(spark, d):
    ev = tables.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("label"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("perplexity"),
    )
    capped = profile.quantile_cap_impute(sampling.stratified_split(ev, "label"), "perplexity")
    return _rounded(capped.select("id", "split", "perplexity"))


@query("class_histogram", """
WITH v AS (
  SELECT event_type AS label, value AS v FROM events
), c AS (SELECT label, quantile_cont(v, 0.99) AS cap FROM v GROUP BY label), k AS (
  SELECT v.label, v.v FROM v JOIN c USING (label) WHERE v.v <= cap
), r AS (SELECT label, min(v) AS lo, (max(v) - min(v)) / 50 AS w, count(*) AS n FROM k GROUP BY label), b AS (
  SELECT k.label, least(floor((v - lo) / w), 49)::INTEGER AS bin, lo, w, n FROM k JOIN r USING (label))
SELECT label, bin, count(*) AS count, round(max(lo) + bin * max(w), 6) AS bin_start,
  round(count(*) / (max(n) * max(w)), 6) AS density FROM b GROUP BY label, bin""")
def _(spark, d):
    ev = tables.table(spark, d, "events").select(F.col("event_type").alias("label"), "value")
    return _rounded(profile.class_histogram(ev, "label", "value"))


@query("box_stats", """
WITH v AS (
  SELECT event_type AS label, value AS v FROM events
), k AS (
  SELECT label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
  FROM v GROUP BY label
), j AS (
  SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN k USING (label))
SELECT label, count(*) AS n, round(max(q1), 6) AS q1, round(max(med), 6) AS median, round(max(q3), 6) AS q3,
  round(min(v) FILTER (inside), 6) AS whisker_low, round(max(v) FILTER (inside), 6) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY label""")
def _(spark, d):
    ev = tables.table(spark, d, "events").select(F.col("event_type").alias("label"), "value")
    return _rounded(profile.box_stats(ev, "label", "value"))


@query("box_outliers", """
WITH k AS (
  SELECT event_type AS label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)
SELECT event_id, event_type AS label, value FROM events JOIN k ON label = event_type
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(spark, d):
    ev = tables.table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("label"), "value"
    )
    return profile.box_outliers(ev, "label", "value", profile.box_stats(ev, "label", "value"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = sorted({p for a, b in combinations_with_replacement(_NUM, 2) for p in ((a, b), (b, a))})


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a, b in _PAIRS
))
def _(spark, d):
    return _rounded(profile.correlation_matrix(tables.table(spark, d, "lineitem"), _NUM))


@query("minmax_class_profile", f"WITH {_LABELLED}" + " UNION ALL ".join(f"""
SELECT '{f}' AS feature, label, round((avg({f}) - (SELECT min({f}) FROM lab))
  / (SELECT max({f}) - min({f}) FROM lab), 6) AS scaled_mean FROM lab GROUP BY label""" for f in _FEATS))
def _(spark, d):
    return _rounded(profile.minmax_class_profile(_labelled(spark, d), "label", _FEATS))


@query("dataset_metrics", f"""
WITH {_LABELLED}
SELECT count(*) AS total_rows, count(*) FILTER (label = 0) AS agent_rows,
  count(*) FILTER (label = 1) AS human_rows, min(word_count) AS min_words, max(word_count) AS max_words FROM lab""")
def _(spark, d):
    return profile.dataset_metrics(_labelled(spark, d))
