"""Queries over prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.scalars import probability_band
from threadlens.operators import metrics as m
from threadlens.plans.registry import query
from threadlens.plans.threads import _rounded
from threadlens.sources import tables

# Labels against a length rule: long documents are predicted to be of quality 1.
_PRED = """p AS (
  SELECT doc_id, quality AS label, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS prediction,
         n_chars::DOUBLE AS score, abs(quality - toxic) / 2.0 AS loss
  FROM labels JOIN documents USING (doc_id))"""


def _predictions(spark, d):
    lab = tables.table(spark, d, "labels")
    docs = tables.table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("prediction"),
        F.col("n_chars").cast("double").alias("score"),
        (F.abs(F.col("quality") - F.col("toxic")) / 2).alias("loss"),
    )


@query("binary_metrics", f"""
WITH {_PRED}, c AS (
  SELECT count(*) AS n, avg((label = prediction)::INTEGER) AS accuracy, avg(loss) AS loss,
    count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> prediction) AS miss FROM p)
SELECT n, round(accuracy, 6) AS accuracy, round(2 * tp / (2 * tp + miss)::DOUBLE, 6) AS f1,
  round(loss, 6)::DOUBLE AS loss FROM c""")
def _(spark, d):
    return _rounded(m.binary_metrics(_predictions(spark, d), loss="loss"))


@query("confusion_matrix", f"""
WITH {_PRED}
SELECT label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1
FROM p GROUP BY label""")
def _(spark, d):
    return m.confusion_matrix(_predictions(spark, d), [0, 1])


@query("classification_report", f"""
WITH {_PRED}, k AS (
  SELECT c, count(*) FILTER (label = c AND prediction = c)::DOUBLE AS tp,
    count(*) FILTER (prediction = c)::DOUBLE AS pp, count(*) FILTER (label = c) AS sup
  FROM p, (VALUES (0), (1)) AS v(c) GROUP BY c
), s AS (SELECT c, tp / pp AS precision, tp / sup AS recall, 2 * tp / (pp + sup) AS f1, sup FROM k)
SELECT c::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, sup AS support FROM s
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n
  FROM (SELECT avg((label = prediction)::INTEGER) AS a, count(*) AS n FROM p)
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(sup)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * sup) / sum(sup), 6), round(sum(recall * sup) / sum(sup), 6),
  round(sum(f1 * sup) / sum(sup), 6), sum(sup)::BIGINT FROM s""")
def _(spark, d):
    return _rounded(m.classification_report(_predictions(spark, d), [0, 1]))


_ROC = """
r AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM p GROUP BY score
), c AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
    sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM r WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", f"""
WITH {_PRED}, {_ROC}
SELECT score AS threshold, round(fp / an::DOUBLE, 6) AS fpr, round(tp / ap::DOUBLE, 6) AS tpr FROM c
UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def _(spark, d):
    curve = m.roc_curve(_predictions(spark, d))
    return curve.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_auc", f"""
WITH {_PRED}, pn AS (
  SELECT a.score AS ps, b.score AS ns FROM p a, p b WHERE a.label = 1 AND b.label = 0)
SELECT round(avg(CASE WHEN ps > ns THEN 1.0 WHEN ps = ns THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS auc FROM pn""")
def _(spark, d):
    return _rounded(m.roc_auc(_predictions(spark, d)))


@query("roc_auc_hard", f"""
WITH {_PRED}
SELECT round((avg((prediction = 1)::INTEGER) FILTER (label = 1)
  + avg((prediction = 0)::INTEGER) FILTER (label = 0)) / 2, 6) AS auc FROM p""")
def _(spark, d):
    """On hard 0/1 predictions the area equals the balanced accuracy."""
    return _rounded(m.roc_auc(_predictions(spark, d), score="prediction"))


@query("select_best_epoch", """
WITH e AS (
  SELECT dayofyear(ts)::INTEGER AS epoch, round(avg(value), 3) AS score FROM events GROUP BY 1
), b AS (
  SELECT *, coalesce(score >= max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AS improved FROM e
), g AS (
  SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM b
), r AS (SELECT *, epoch <= coalesce((SELECT min(epoch) FROM g WHERE waited >= 3), 10000) AS ran FROM g)
SELECT epoch, score, improved, waited::INTEGER AS waited, ran,
  epoch = (SELECT max(epoch) FROM r WHERE ran AND improved) AS is_best FROM r""")
def _(spark, d):
    """Daily mean event values stand in for validation scores."""
    days = tables.table(spark, d, "events").groupBy(F.dayofyear("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 3).alias("score")
    )
    return m.select_best_epoch(days)


@query("probability_band", """
SELECT vec_id, CASE WHEN p * 100 < 35 THEN '0-35' WHEN p * 100 < 65 THEN '35-65' ELSE '65-100' END AS band
FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 4 AS p FROM embeddings)""")
def _(spark, d):
    p = F.abs(F.col("embedding")[0].cast("double")) * 4
    return tables.table(spark, d, "embeddings").select("vec_id", probability_band(p).alias("band"))
