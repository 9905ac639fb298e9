"""Blocks in regions: vectors travel once to each region, and results do not depend on the regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_vectors import brute_density, similarity
from threadlens.operators import neighbours


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def shapeless():
    """Vectors without structure, so no block can be left out."""
    return np.random.default_rng(11).normal(size=(400, 12))


def test_vectors_travel_to_regions_not_blocks(spark, shapeless):
    vb = neighbours.VectorBlocks(frame(spark, shapeless), pivots=60, block_rows=4)
    assert vb.n_blocks.sum() > 3 * neighbours._REGIONS
    everywhere = vb.blocks.withColumns({"reach": F.lit(2.0), "core": F.lit(True)})
    assert vb.visits(everywhere, skip_own=False).count() == 400 * neighbours._REGIONS


def test_regions_grow_with_rows_only(spark, shapeless):
    vb = neighbours.VectorBlocks(frame(spark, shapeless), pivots=60, block_rows=4)
    usual, small = vb.regions(), vb.regions(region_rows=10)
    assert len(usual) == vb.n_blocks.sum() and set(usual) == set(range(neighbours._REGIONS))
    assert small.max() + 1 == 40


@pytest.mark.parametrize("regions", [1, 3])
def test_lists_and_clusters_in_few_regions(spark, shapeless, monkeypatch, regions):
    monkeypatch.setattr(neighbours, "_REGIONS", regions)
    m = np.concatenate([shapeless[:150], shapeless[:150] + np.random.default_rng(2).normal(size=(150, 12)) * 0.3])
    df, sim = frame(spark, m), similarity(m)
    got = {}
    for r in neighbours.knn_graph(df, 7, pivots=9, block_rows=8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    np.fill_diagonal(sim, -np.inf)
    assert got == {i: dict(enumerate(np.lexsort((np.arange(300), -sim[i]))[:7], 1)) for i in range(300)}
    mine = {}
    for r in neighbours.density_clusters(df, 0.7, 3, 5, pivots=9, block_rows=8).collect():
        mine.setdefault(r["cluster_id"], set()).add(r["id"])
    mine.pop(-1, None)
    assert {frozenset(g) for g in mine.values()} == brute_density(np.arange(300), m, 0.7, 3, 5)
