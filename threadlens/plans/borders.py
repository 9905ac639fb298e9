"""Queries over learned sentence borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.text import population_std
from threadlens.operators import borders
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import prepared

TYPES = f"""{q.BASE}, w AS (
  SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM base
), typed AS (
  SELECT id, i, n, regexp_matches(w, '[.!?]$') AS ends, regexp_matches(w, '{borders.ONE_PERIOD}') AS p,
    regexp_replace(lower(regexp_replace(w, '\\.$', '')), '{borders.LEADING}', '') AS word_type FROM w
), counted AS (
  SELECT word_type, count(*) FILTER (p) AS n_with, count(*) FILTER (NOT p) AS n_without
  FROM typed WHERE regexp_matches(word_type, '{borders.WORD_TYPE}') GROUP BY word_type
), share AS (
  SELECT least(greatest(sum(n_with) / sum(n_with + n_without), 1e-9), 1 - 1e-9) AS s FROM counted
), scored AS (
  SELECT word_type, n_with, n_without, length(replace(word_type, '.', '')) AS l,
    2 * (n_with * (ln({borders.PERIOD_SHARE}) - ln(s)) + n_without * (ln({1 - borders.PERIOD_SHARE}) - ln(1 - s)))
      * (length(word_type) - l + 1) * exp(-l - n_without * ln(l)) AS score
  FROM counted, share
), abbr AS (SELECT * FROM scored WHERE n_with > 0 AND score >= {borders.MIN_SCORE})"""


@query("abbreviation_types", f"WITH {TYPES} SELECT word_type, n_with, n_without, round(score, 6) AS score FROM abbr")
def _(spark, d):
    found = borders.abbreviation_types(prepared(spark, d), "text_clean")
    return found.select("word_type", "n_with", "n_without", F.round("score", 6).alias("score"))


@query("learned_sentences", f"""
WITH {TYPES}, ends AS (
  SELECT id, i, p AND word_type IN (SELECT word_type FROM abbr) AS kept FROM typed WHERE ends AND i < n
), cuts AS (
  SELECT id, i FROM ends WHERE NOT kept UNION ALL SELECT id, len(ws) FROM base WHERE len(ws) > 0
), lengths AS (
  SELECT id, i - coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), 0) AS l FROM cuts
), kept AS (SELECT id, count(*) AS a FROM ends WHERE kept GROUP BY id)
SELECT id, count(*) AS sentence_count, max(l) AS longest, round(stddev_pop(l), 6) AS sentence_length_std,
  coalesce(any_value(a), 0) AS n_abbreviations
FROM lengths LEFT JOIN kept USING (id) GROUP BY id""")
def _(spark, d):
    docs = prepared(spark, d)
    split = borders.sentence_borders(docs, "text_clean", borders.abbreviation_types(docs, "text_clean"))
    return split.filter(F.size("sentence_words") > 0).select(
        "id", F.size("sentence_words").cast("long").alias("sentence_count"),
        F.array_max("sentence_words").alias("longest"),
        F.round(population_std(F.col("sentence_words")), 6).alias("sentence_length_std"), "n_abbreviations")
