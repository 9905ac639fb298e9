"""Hierarchical density clusters against a brute-force version that works from the top down."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens.operators import hierarchy


def parts_below(far, rows, h):
    """Connected parts of the rows when only pairs nearer than h are joined."""
    left, out = set(rows), []
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            seen.add(p)
            near = [q for q in left if far[p, q] < h]
            left.difference_update(near)
            todo.extend(near)
        out.append(sorted(seen))
    return out


def brute(m, min_points, min_size):
    """Chosen clusters as sets of row numbers: every pair, from the largest distance down."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(2 - 2 * np.round(unit @ unit.T, 12), 0)), 9)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min_points - 1]
    far = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def cluster(rows, birth):
        """(value, chosen sets) of the cluster that these rows are when it begins."""
        everyone, total, alive = list(rows), 0.0, list(rows)
        while True:
            h = min(x for x in np.unique(far[np.ix_(alive, alive)]) if len(parts_below(far, alive, x + 1e-12)) == 1)
            parts = parts_below(far, alive, h)
            big = [p for p in parts if len(p) >= min_size]
            rate = 1 / max(h, hierarchy.SHORTEST)
            if len(big) == 1:
                total += (len(alive) - len(big[0])) * (rate - birth)
                alive = big[0]
                continue
            total += len(alive) * (rate - birth)
            below = [cluster(p, rate) for p in big]
            value = sum(v for v, _ in below)
            if total >= value:
                return total, [frozenset(everyone)]
            return value, [s for _, sets in below for s in sets]

    # The cluster of all rows is never chosen, so only what is below its first split counts.
    alive = list(range(len(m)))
    while True:
        levels = np.unique(far[np.ix_(alive, alive)])
        h = next(x for x in levels if len(parts_below(far, alive, x + 1e-12)) == 1)
        big = [p for p in parts_below(far, alive, h) if len(p) >= min_size]
        if len(big) == 1:
            alive = big[0]
            continue
        return {s for p in big for s in cluster(p, 1 / max(h, hierarchy.SHORTEST))[1]}


def points(seed, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 6)) * 3
    m = np.concatenate([c + rng.normal(size=(22, 6)) * s for c, s in zip(centers, (0.2, 0.5, 0.8, 0.3))]
                       + [rng.normal(size=(14, 6))])
    if copies:
        m[3:3 + copies] = m[3]
        m[60:63] = m[60]
    return m


def frame(spark, m, ids):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id long, embedding array<double>")


@pytest.mark.parametrize("seed, copies, task_edges, blocks", [
    (1, 0, 200_000, {}), (2, 9, 20, {"pivots": 6, "block_rows": 8}),
])
def test_equals_brute_force(spark, seed, copies, task_edges, blocks):
    m = points(seed, copies)
    ids = np.random.default_rng(seed).permutation(len(m)) + 10
    rows = hierarchy.density_hierarchy(frame(spark, m, ids), 4, 8, task_edges=task_edges, **blocks).collect()
    assert sorted(r["id"] for r in rows) == sorted(ids)
    mine = {}
    for r in rows:
        assert (r["cluster_id"] == -1) == (r["stability"] is None)
        mine.setdefault(r["cluster_id"], set()).add(r["id"])
    mine.pop(-1, None)
    assert all(k == min(v) for k, v in mine.items())
    want = {frozenset(int(ids[i]) for i in s) for s in brute(m, 4, 8)}
    assert len(want) > 1 and {frozenset(int(i) for i in s) for s in mine.values()} == want


def test_tree_weights_equal_prim(spark):
    """The spanning edges join the same components at each distance as all pairs do."""
    m = points(5)
    df = frame(spark, m, range(len(m)))
    vb = hierarchy.VectorBlocks(df, pivots=5, block_rows=16)
    pts, near = hierarchy.reachability(df, vb, 4)
    edges = hierarchy.spanning_edges(pts, near, vb).distinct().toPandas()
    core = pts.toPandas().set_index("rep")["far"].sort_index().to_numpy()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    far = np.maximum(np.maximum(hierarchy._chord(unit @ unit.T), core[:, None]), core[None, :])
    for h in np.quantile(far, [0.01, 0.05, 0.2, 0.5, 0.9]):
        tree = np.full((len(m), len(m)), np.inf)
        for e in edges[edges["w"] < h].itertuples():
            tree[e.a, e.b] = tree[e.b, e.a] = e.w
        assert sorted(parts_below(tree, range(len(m)), h)) == sorted(parts_below(far, range(len(m)), h))


def test_ties_merge_at_once():
    """Four equal edges around a ring of small parts make one cluster, in whatever order they come."""
    nodes = pd.DataFrame([{"comp": i, "size": 2, "cluster": None, "total": 0.0, "kids": 0.0, "members": [i]} for i in range(4)])
    ring = pd.DataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5), (3, 0, 0.5)], columns=["a", "b", "w"])
    for seed in range(4):
        out = hierarchy._merge(nodes, ring.sample(frac=1, random_state=seed), 4)
        assert sorted(out[out["kind"] == "member"]["comp"]) == [0, 1, 2, 3]
        assert set(out["cluster"].dropna()) == {"0.5:0"} and not (out["kind"] == "closed").any()
        assert out[out["kind"] == "state"]["total"].tolist() == [16.0]


def test_few_rows_and_no_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, embedding array<double>")
    assert {(r["id"], r["cluster_id"]) for r in hierarchy.density_hierarchy(df, 3, 2).collect()} == {(1, -1), (2, -1), (3, -1)}
    assert hierarchy.density_hierarchy(df.filter(F.lit(False)), 3, 2).count() == 0
