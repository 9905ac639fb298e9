"""Queries over embeddings: centroids, projection, clusters and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import hierarchy
from threadlens.operators import neighbours as nb
from threadlens.operators import vectors as v
from threadlens.plans.registry import query
from threadlens.plans.threads import _rounded
from threadlens.sources import tables

_DIMS = 64
_LONG = """l AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


@query("group_centroid", f"""
WITH {_LONG}
SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS value FROM l GROUP BY label, pos""")
def _(spark, d):
    c = v.group_centroid(tables.vectors(spark, d), "label")
    return _rounded(c.select("label", F.posexplode("centroid").alias("pos", "value")))


@query("centroid_homogeneity", f"""
WITH {_LONG}, c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY label, pos), s AS (
  SELECT vec_id, l.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cs
  FROM l JOIN c USING (label, pos) GROUP BY vec_id, l.label)
SELECT label, round(avg(cs), 6) AS homogeneity, count(*) AS n FROM s GROUP BY label""")
def _(spark, d):
    return _rounded(v.centroid_homogeneity(tables.vectors(spark, d), "label"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardize", f"""
SELECT l_orderkey, l_linenumber, {", ".join(
    f"round((c.{n} - avg(c.{n}) OVER ()) / stddev_pop(c.{n}) OVER (), 5) AS {n}" for n in _NUM)},
  0.0::DOUBLE AS constant
FROM lineitem c""")
def _(spark, d):
    lines = tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *_NUM, F.lit(3.0).alias("constant")
    )
    return _rounded(v.standardize(lines, _NUM + ["constant"]), 5)


def _points(spark, d):
    from pyspark.ml.functions import array_to_vector

    vecs = tables.vectors(spark, d)
    return vecs.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


@query("pca_project")
def _(spark, d):
    points, explained = v.pca_project(_points(spark, d), "features", 2)
    return points.select("id", "label", "pc1", "pc2", F.lit(explained).alias("explained_variance"))


def _clusters(spark, d, dims):
    vecs = tables.vectors(spark, d)
    names = [f"e{i}" for i in range(_DIMS)]
    # Even source labels are agents, odd ones humans.
    wide = vecs.select(
        "id", (F.col("label") % 2).alias("label"),
        *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)],
    )
    placed, explained = v.kmeans_clusters(wide, names, k=5, dims=dims)
    keep = ["id", "cluster_id", "cluster_size", *[f"pc{i + 1}" for i in range(dims)]]
    return placed.select(*keep, F.lit(explained).alias("explained_variance"))


@query("kmeans_clusters")
def _(spark, d):
    return _clusters(spark, d, 2)


@query("kmeans_clusters_3d")
def _(spark, d):
    return _clusters(spark, d, 3)


_COS = """s AS (
  SELECT a.vec_id AS id, b.vec_id AS neighbor, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cs
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
), r AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(cs, 12) DESC, neighbor)::INTEGER AS rank, neighbor, cs
  FROM s)"""


@query("knn_graph", f"WITH {_COS} SELECT id, rank, neighbor, round(cs, 6) AS similarity FROM r WHERE rank <= 15")
def _(spark, d):
    return _rounded(nb.knn_graph(tables.vectors(spark, d), 15))


@query("neighbour_sweep", f"""
WITH {_COS}
SELECT k, count(*) AS n_edges, round(avg(cs), 6) AS mean_similarity
FROM r, (VALUES (15), (50), (100), (200)) AS v(k) WHERE rank <= k GROUP BY k""")
def _(spark, d):
    graph = nb.knn_graph(tables.vectors(spark, d), 200)
    return _rounded(nb.neighbour_sweep(graph, [15, 50, 100, 200]))


@query("density_clusters")
def _(spark, d):
    return nb.density_clusters(
        tables.vectors(spark, d), min_similarity=0.3, min_points=5, min_cluster_size=10
    )


@query("density_hierarchy")
def _(spark, d):
    return hierarchy.density_hierarchy(tables.vectors(spark, d), min_points=5, min_cluster_size=10)
