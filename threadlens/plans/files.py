"""Queries over scans and sinks. A sink writes to a fresh folder and the query reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import textfeat
from threadlens.operators.project import feature_columns
from threadlens.operators.sampling import stratified_split
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import prepared
from threadlens.session import fresh_path, materialize
from threadlens.sources import files, tables

_DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_CSV_SQL = "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"


def _csv_round_trip(spark, d, name):
    docs = tables.table(spark, d, "documents")
    path = files.sink_csv(docs, fresh_path(spark, name))
    back = files.scan_csv(spark, path, _DOCS)
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("scan_csv", _CSV_SQL)
def _(spark, d):
    return _csv_round_trip(spark, d, "scan-csv")


@query("sink_csv", _CSV_SQL)
def _(spark, d):
    return _csv_round_trip(spark, d, "sink-csv")


@query("scan_parquet", "SELECT doc_id, lang FROM documents WHERE n_chars >= 1000")
def _(spark, d):
    docs = files.scan_parquet(spark, f"{d}/documents.parquet", ["doc_id", "lang", "n_chars"])
    return docs.filter(F.col("n_chars") >= 1000).select("doc_id", "lang")


@query("scan_tagged_partitions", """
SELECT doc_id, md5(text) AS digest, source AS subreddit FROM documents
WHERE source IN ('src0', 'src3', 'src11')""")
def _(spark, d):
    docs = tables.table(spark, d, "documents").withColumnRenamed("source", "subreddit")
    path = files.sink_partitioned(docs, fresh_path(spark, "tagged"), "subreddit")
    schema = "doc_id long, text string, lang string, n_chars long, subreddit string"
    tagged = files.scan_tagged_partitions(spark, path, schema, ["src0", "src3", "src11"])
    return tagged.select("doc_id", F.md5("text").alias("digest"), "subreddit")


@query("merge_checkpoints", """
SELECT doc_id AS id, md5(text) AS digest FROM documents
UNION ALL SELECT item_id, md5(text) FROM benchmark
UNION ALL SELECT conv_id, md5(text) FROM conversations""")
def _(spark, d):
    path = fresh_path(spark, "parts")
    for part, id_col in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")):
        rows = tables.table(spark, d, part).select(
            F.col(id_col).alias("id"), "text", F.upper("text").alias("safe_content")
        )
        rows.write.parquet(f"{path}/{part}")
    merged = files.merge_checkpoints(spark, path, "id long, text string, safe_content string")
    return merged.select("id", F.md5("text").alias("digest"))


def _split_docs(spark, d):
    docs = textfeat.add_features(
        prepared(spark, d), "text_clean", ["length", "punctuation", "special"]
    )
    vecs = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = docs.withColumnRenamed("community", "source").join(vecs, "id", "left")
    return materialize(stratified_split(docs, "lang"), "features")


_SPLIT_SQL = f"""
WITH {q.BASE}, s AS (SELECT * FROM {q.split_sql('base', 'lang')})"""


@query("sink_feature_matrix", f"""{_SPLIT_SQL}
SELECT view, split, source, count(*) AS n, sum(word_count)::BIGINT AS words FROM (
  SELECT unnest(['full', 'tabular', 'tabular_embedding']) AS view, split, community AS source,
         len(ws) AS word_count FROM s)
GROUP BY ALL""")
def _(spark, d):
    df = _split_docs(spark, d)
    features = [c for c in feature_columns(df) if c != "lang"]
    paths = files.sink_feature_matrix(df, fresh_path(spark, "matrix"), features)
    views = [
        spark.read.parquet(path).select(F.lit(name).alias("view"), "split", "source", "word_count")
        for name, path in paths.items()
    ]
    return views[0].unionByName(views[1]).unionByName(views[2]).groupBy(
        "view", "split", "source"
    ).agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


@query("sink_embedding_split", """
WITH s AS (SELECT * FROM """ + q.split_sql("(SELECT vec_id AS id, embedding, label FROM embeddings)", "label") + """)
SELECT id, split, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM s""")
def _(spark, d):
    df = stratified_split(tables.vectors(spark, d), "label")
    path = files.sink_embedding_split(df, fresh_path(spark, "embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("id", "split", F.round(total, 6).alias("total"))


@query("export_filtered_view", """
SELECT source AS author, lang AS subreddit, n_chars AS word_count, md5(text) AS digest FROM documents""")
def _(spark, d):
    docs = tables.table(spark, d, "documents").select(
        F.col("source").alias("author"), "text", F.col("lang").alias("subreddit"),
        F.col("n_chars").alias("word_count"),
    )
    show = ["author", "text", "subreddit", "label", "word_count", "sentiment_compound"]
    path = files.export_filtered_view(docs, fresh_path(spark, "view"), show)
    back = files.scan_csv(
        spark, path, "author string, text string, subreddit string, word_count long"
    )
    return back.select("author", "subreddit", "word_count", F.md5("text").alias("digest"))
