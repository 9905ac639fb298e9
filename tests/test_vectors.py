"""Neighbours, clusters, projection and topics against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from threadlens.operators import neighbours, topics, vectors


@pytest.fixture(scope="module")
def cloud(spark):
    """Clustered points with many exact copies of one vector, so copies cross the k + 1 cut."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 3
    m = np.concatenate([c + rng.normal(size=(40, 8)) * 0.4 for c in centers] + [rng.normal(size=(30, 8))])
    m[100:130] = m[100]
    m[5] = m[250]
    ids = rng.permutation(len(m)) + 10
    return ids, m, spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id long, embedding array<double>")


def similarity(m):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(unit @ unit.T, 12)


@pytest.mark.parametrize("shape", [dict(pivots=7, block_rows=16), dict(pivots=1, block_rows=8), {}])
def test_knn_is_exact(cloud, shape):
    ids, m, df = cloud
    k = 9
    got = {}
    for r in neighbours.knn_graph(df, k, **shape).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["similarity"])
    sim = similarity(m)
    np.fill_diagonal(sim, -np.inf)
    assert len(got) == len(ids)
    for row, i in enumerate(ids):
        best = sorted(zip(-np.round(sim[row], 9), ids))[:k]
        mine = [got[i][r] for r in range(1, k + 1)]
        assert [n for n, _ in mine] == [n for _, n in best]
        assert [s for _, s in mine] == pytest.approx([-s for s, _ in best], abs=1e-9)


def test_knn_far_blocks_are_pruned(spark, cloud):
    ids, m, df = cloud
    vb = neighbours.VectorBlocks(df, pivots=12, block_rows=16)
    near = vb.blocks.withColumns({"reach": F.lit(0.3), "core": F.lit(True)})
    visits = vb.visits(near, skip_own=False).count()
    assert visits < 0.6 * near.count() * vb.n_blocks.sum()


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])],
                               "id long, embedding array<double>")
    rows = neighbours.knn_graph(df, 5).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbor"]) for r in rows] == [(1, 4), (1, 3), (3, 1), (3, 4), (4, 1), (4, 3)]
    out = {r["id"]: r["cluster_id"] for r in neighbours.density_clusters(df, 0.9, 2, 2).collect()}
    assert out == {1: 1, 2: -1, 3: -1, 4: 1}


def brute_density(ids, m, limit, min_points, min_size):
    sim = similarity(m)
    close = sim >= limit
    core = close.sum(axis=1) >= min_points
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in list(label):
            near = min(label[j] for j in np.flatnonzero(close[i] & core))
            if near < label[i]:
                label[i], changed = near, True
    groups = {}
    for i, g in label.items():
        groups.setdefault(g, set()).add(i)
    for i in np.flatnonzero(~core):
        cand = np.flatnonzero(close[i] & core)
        if len(cand):
            top = cand[np.isclose(sim[i, cand], sim[i, cand].max(), atol=1e-12)]
            groups[label[top[np.argmin(ids[top])]]].add(i)
    return {frozenset(ids[j] for j in g) for g in groups.values() if len(g) >= min_size}


@pytest.mark.parametrize("shape", [dict(pivots=9, block_rows=16), {}])
def test_density_clusters_match_brute_force(cloud, shape):
    ids, m, df = cloud
    rows = neighbours.density_clusters(df, 0.97, min_points=6, min_cluster_size=12, **shape).collect()
    assert len(rows) == len(ids)
    mine = {}
    for r in rows:
        mine.setdefault(r["cluster_id"], set()).add(r["id"])
    mine.pop(-1, None)
    want = brute_density(ids, m, 0.97, 6, 12)
    assert want and {frozenset(g) for g in mine.values()} == want


def test_components_on_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(500, 500)]
    got = {r["node"]: r["label"] for r in neighbours.connected_components(
        spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[500] == 500


def test_pca_and_standardize(cloud):
    ids, m, df = cloud
    points, explained = vectors.pca_project(
        df.withColumn("features", array_to_vector("embedding")), "features", 2)
    got = np.array([[r["pc1"], r["pc2"]] for r in points.orderBy("id").collect()])
    c = m[np.argsort(ids)]
    c = c - c.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    for i in range(2):
        axis = vt[i] * (1 if vt[i][np.abs(vt[i]).argmax()] > 0 else -1)
        assert got[:, i] == pytest.approx(c @ axis, abs=1e-6)
    assert explained == pytest.approx((s[:2] ** 2).sum() / (s ** 2).sum())
    z = vectors.standardize(df.select("id", F.col("embedding")[0].alias("a"), F.lit(1.0).alias("b")), ["a", "b"])
    r = z.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1) and r[2] == 0


def test_kmeans_codes_and_sizes(spark, cloud):
    ids, m, df = cloud
    wide = df.select("id", F.lit(0).alias("label"), *[F.col("embedding")[i].alias(f"e{i}") for i in range(8)])
    names = [f"e{i}" for i in range(8)]
    assert vectors.kmeans_clusters(wide.drop("label"), names)[1] == "NO_LABEL_COLUMN"
    assert vectors.kmeans_clusters(wide, names, label=1)[1] == "NO_AI_ROWS"
    assert vectors.kmeans_clusters(wide, ["e0", "zz"])[1] == "INSUFFICIENT_NUMERIC_FEATURES"
    assert vectors.kmeans_clusters(wide.limit(2), names)[1] == "NOT_ENOUGH_AI_SAMPLES"
    placed, explained = vectors.kmeans_clusters(wide, names, k=4, inits=2)
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("cluster_size").alias("s")).collect()
    assert sum(r["n"] for r in sizes) == len(ids) and all(r["n"] == r["s"] for r in sizes)
    assert 0 < explained <= 1


def test_topics_separate_and_merge(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        g = i % 3
        v = np.eye(3)[g] + rng.normal(size=3) * 0.05
        word = ["apple pear fruit", "engine wheel car", "engine wheel car"][g]
        rows.append((i, f"{word} w{i}", [float(x) for x in v]))
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    model, placed = topics.fit_topics(df, "text", k=3, min_topic_size=5, min_similarity=0.5, merge_at=0.7)
    got = {r["id"]: r["topic_id"] for r in placed.collect()}
    assert {got[i] for i in range(90) if i % 3} == {0} and {got[i] for i in range(0, 90, 3)} == {1}
    info = {r["topic_id"]: r for r in topics.topic_terms(placed, "text").collect()}
    assert info[0]["count"] == 60 and info[1]["name"].startswith("1_apple_fruit_pear_")
    far = spark.createDataFrame([(0, "x", [-1.0, -1.0, -1.0])], df.schema)
    assert model.transform(far).first()["topic_id"] == -1
