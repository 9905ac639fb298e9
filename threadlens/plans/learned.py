"""Queries over topics and classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from threadlens.operators import classify, epochs, matrix, metrics, modelfeat, sampling, scoring, topicmerge, topics
from threadlens.operators.textfeat import add_features
from threadlens.operators.vectors import group_centroid
from threadlens.plans import sqltext as q
from threadlens.plans.models import _tokens
from threadlens.plans.registry import query
from threadlens.plans.textual import prepared
from threadlens.plans.threads import _rounded
from threadlens.session import fresh_path, materialize
from threadlens.sources import tables


def _embedded(spark, d):
    docs = sampling.stratified_split(prepared(spark, d), "lang")
    weights = modelfeat.slot_weights(docs.filter(F.col("split") == "train"), "text_clean")
    return materialize(modelfeat.embed_texts(docs, "text_clean", weights=weights), "embedded")


@query("fit_topics")
def _(spark, d):
    docs = _embedded(spark, d)
    model, _ = topics.fit_topics(docs.filter(F.col("split") == "train"), "text_clean")
    return model.transform(docs).select("id", "split", "topic_id", "topic_similarity")


_ALIKE = f"""{q.BASE}, t AS (
  SELECT concat_ws('/', community, lang) AS topic_id, unnest({_tokens('lower(text_clean)')}) AS term FROM base
), c AS (SELECT topic_id, term, count(*) AS n FROM t GROUP BY ALL),
tot AS (SELECT topic_id, sum(n) AS total FROM c GROUP BY topic_id),
f AS (SELECT term, sum(n) AS f FROM c GROUP BY term),
w AS (SELECT topic_id, term, n / total * ln(1 + (SELECT avg(total) FROM tot) / f) AS w
  FROM c JOIN tot USING (topic_id) JOIN f USING (term)),
u AS (SELECT topic_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id)) AS u FROM w),
p AS (SELECT x.topic_id AS a, y.topic_id AS b, round(sum(x.u * y.u), 9) AS cosine
  FROM u x JOIN u y USING (term) WHERE x.topic_id < y.topic_id GROUP BY 1, 2 HAVING cosine >= 0.5)"""


def _community_terms(spark, d):
    docs = prepared(spark, d).withColumn("topic_id", F.concat_ws("/", "community", "lang"))
    return materialize(topics.term_counts(docs, "text_clean"), "term-counts")


@query("similar_topics", f"WITH {_ALIKE} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def _(spark, d):
    return _rounded(topicmerge.similar_topics(_community_terms(spark, d), 0.5))


@query("topic_merge_step", f"""
WITH RECURSIVE {_ALIKE}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT topic_id AS node, topic_id AS label FROM tot UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
SELECT node AS topic_id, min(label) AS merged FROM r GROUP BY node""")
def _(spark, d):
    return topicmerge.merge_topics(_community_terms(spark, d), 0.5, rounds=1)


@query("density_topics")
def _(spark, d):
    docs = _embedded(spark, d).filter(F.col("split") == "train")
    return topicmerge.density_topics(docs, "text_clean").select("id", "topic_id")


@query("topic_terms", f"""
WITH {q.BASE}, t AS (
  SELECT substr(community, 4)::INTEGER AS topic_id, unnest({_tokens('lower(text_clean)')}) AS term FROM base
), c AS (SELECT topic_id, term, count(*) AS n FROM t GROUP BY ALL),
tot AS (SELECT topic_id, sum(n) AS total FROM c GROUP BY topic_id),
f AS (SELECT term, sum(n) AS f FROM c GROUP BY term),
w AS (SELECT topic_id, term, round(n / total * ln(1 + (SELECT avg(total) FROM tot) / f), 12) AS w
  FROM c JOIN tot USING (topic_id) JOIN f USING (term)),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY w DESC, term) <= 10),
l AS (SELECT topic_id, list(term ORDER BY w DESC, term) AS terms FROM b GROUP BY topic_id),
s AS (SELECT substr(community, 4)::INTEGER AS topic_id, count(*) AS count FROM base GROUP BY 1)
SELECT topic_id, count, topic_id || '_' || array_to_string(terms[1:4], '_') AS name,
  array_to_string(terms, ' ') AS terms FROM s JOIN l USING (topic_id)""")
def _(spark, d):
    docs = prepared(spark, d).withColumn("topic_id", F.substring("community", 4, 9).cast("int"))
    info = topics.topic_terms(docs, "text_clean")
    return info.withColumn("terms", F.array_join("terms", " "))


_SPLIT_VECS = "s AS (SELECT * FROM " + q.split_sql("(SELECT vec_id AS id, embedding, label FROM embeddings)", "label") + ")"
_ASSIGN = f"""{_SPLIT_VECS}, l AS (
  SELECT id, label, split, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM s
), c AS (SELECT label AS topic, pos, avg(x) AS m FROM l WHERE split = 'train' GROUP BY label, pos
), d AS (
  SELECT id, split, topic, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cs
  FROM l JOIN c USING (pos) GROUP BY id, split, topic
), a AS (
  SELECT id, split, CASE WHEN max(cs) < 0.25 THEN -1 ELSE arg_max(topic, cs) END AS topic_id,
    max(cs) AS cs FROM d GROUP BY id, split)"""


def _assigned(spark, d):
    vecs = sampling.stratified_split(tables.vectors(spark, d), "label")
    centers = group_centroid(vecs.filter(F.col("split") == "train"), "label").orderBy("label").collect()
    return topics.assign_topics(
        vecs, np.array([r["centroid"] for r in centers]), [r["label"] for r in centers],
        min_similarity=0.25,
    )


@query("assign_topics", f"WITH {_ASSIGN} SELECT id, split, topic_id, round(cs, 6) AS topic_similarity FROM a")
def _(spark, d):
    return _rounded(_assigned(spark, d).select("id", "split", "topic_id", "topic_similarity"))


@query("topic_outlier_counts", f"""
WITH {_ASSIGN}
SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'val+test' END AS part, count(*) AS n,
  count(*) FILTER (topic_id = -1) AS outliers, count(DISTINCT CASE WHEN topic_id <> -1 THEN topic_id END) AS topics
FROM a GROUP BY 1""")
def _(spark, d):
    return topics.topic_outlier_counts(_assigned(spark, d))


def _labelled_features(spark, d):
    lab = tables.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    docs = sampling.stratified_split(prepared(spark, d).join(lab, "id"), "label")
    return materialize(add_features(docs, "text_clean"), "labelled-features")


@query("fit_forest")
def _(spark, d):
    df = _labelled_features(spark, d)
    forest = classify.fit_forest(df.filter(F.col("split") == "train"))
    return forest.transform(df).select(
        "id", "split", "label", "prediction", "probability_agent", "probability_human"
    )


def _scorer(spark, d):
    """A scorer fit on the labelled training documents; the source stands for the author."""
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("author"))
    lab = tables.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    labelled = sampling.stratified_split(materialize(docs.join(lab, "id"), "labelled-texts"), "label")
    return docs, scoring.fit_text_scorer(labelled.filter(F.col("split") == "train"))


@query("score_batch")
def _(spark, d):
    """Every raw document scored by artefacts that are fit on the labelled training ones."""
    docs, scorer = _scorer(spark, d)
    return scorer.transform(docs).select("id", "prediction", "probability_agent", "probability_human", "band")


@query("score_batch_saved", f"""
SELECT doc_id AS id, true AS same_when_loaded, true AS sums_to_one, true AS likelier_class, true AS band_fits
FROM documents WHERE length({q.clean('text')}) > 0""")
def _(spark, d):
    """What must hold for every scored document, and that artefacts saved and loaded in a new session score it the same."""
    docs, scorer = _scorer(spark, d)
    path = fresh_path(spark, "scorer")
    scorer.save(path)
    loaded = scoring.load_text_scorer(spark.newSession(), path)
    now = scorer.transform(docs).select("id", F.struct("prediction", "probability_agent", "probability_human", "band").alias("now"))
    kept = loaded.transform(docs).select("id", F.struct("prediction", "probability_agent", "probability_human", "band").alias("kept"))
    agent, human, band = F.col("now.probability_agent"), F.col("now.probability_human"), F.col("now.band")
    fits = F.when(agent < 0.35, band == "0-35").when(agent < 0.65, band == "35-65").otherwise(band == "65-100")
    return now.join(kept, "id").select(
        "id", F.col("now").eqNullSafe(F.col("kept")).alias("same_when_loaded"), (F.abs(agent + human - 1) < 1e-9).alias("sums_to_one"),
        (F.col("now.prediction") == (human > agent).cast("double")).alias("likelier_class"), fits.alias("band_fits"))


@query("fit_text_classifier")
def _(spark, d):
    lab = tables.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    docs = materialize(
        sampling.stratified_split(prepared(spark, d).join(lab, "id"), "label"), "labelled-texts"
    )
    model, _ = epochs.train_by_epochs(docs, "text_clean")
    return model.transform(docs, "text_clean").select("id", "split", "label", "prediction", "probability")


@query("text_classifier_epochs", """
SELECT 'train ran and learned' AS what, true AS holds UNION ALL
SELECT 'loss never above that of zero weights', true UNION ALL
SELECT 'at most 20 epochs', true UNION ALL
SELECT 'one best epoch, the last of the highest accuracy', true UNION ALL
SELECT 'stopped at most 3 epochs after the best', true""")
def _(spark, d):
    """What must hold for the epochs of the classifier on the labelled documents."""
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lab = tables.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    docs = materialize(sampling.stratified_split(docs.join(lab, "id"), "label"), "labelled-texts")
    table = materialize(epochs.train_by_epochs(docs, "text")[1], "epochs")
    marked = metrics.select_best_epoch(table.select("epoch", "score")).join(table.select("epoch", "loss"), "epoch")
    best, top = F.max(F.when(F.col("is_best"), F.col("epoch"))), F.max(F.struct("score", "epoch"))
    facts = marked.agg(
        F.count("*").alias("n"), F.max("epoch").alias("last"), best.alias("best"), top.alias("top"), F.count_if("is_best").alias("marks"),
        F.max("loss").alias("worst"), F.max_by("loss", -F.col("epoch")).alias("first_loss"), F.max_by("loss", "epoch").alias("last_loss"))
    checks = {
        "train ran and learned": F.col("last_loss") <= F.col("first_loss"),
        "loss never above that of zero weights": F.col("worst") <= F.log(F.lit(2.0)) + 1e-9,
        "at most 20 epochs": (F.col("n") == F.col("last")) & (F.col("last") <= 20),
        "one best epoch, the last of the highest accuracy": (F.col("marks") == 1) & (F.col("best") == F.col("top.epoch")),
        "stopped at most 3 epochs after the best": F.col("last") - F.col("best") <= 3,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("holds")) for k, v in checks.items()])
    return facts.select(F.inline(rows))


@query("feature_matrix")
def _(spark, d):
    """Conversation turns as posts and comments of agents (assistant, system) and humans (user)."""
    turns = tables.table(spark, d, "conversations").select(
        F.col("role").alias("author"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("string").alias("created_utc"),
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.length("text").alias("score"),
        F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("subreddit"),
        (F.col("role") == "user").cast("int").alias("label"),
        F.when(F.col("turn") == 0, "post").otherwise("comment").alias("interaction_type"),
        F.col("text").alias("content"), F.col("conv_id").cast("string").alias("post_id"),
    )
    merged = matrix.merge_sources(turns.filter("label = 0"), turns.filter("label = 1"))
    built = matrix.build_feature_matrix(merged, topic_count=8, dim=64)
    return built.rows.select("id", "label", "source", "split", *built.features)
