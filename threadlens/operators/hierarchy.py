"""Density clusters at every radius: a spanning tree of mutual reachability, condensed by stability.

The distance of two rows is the largest of their chord (unit vectors) and both core distances, a core distance being the
chord to the ``min_points``-th nearest row, the row itself counted (Campello et al. 2013). Three steps:

* ``spanning_edges``: Borůvka rounds. Every component takes its lightest edge to another one. What the neighbour lists and the pivots prove
  bounds how far it can be, so only rows whose core distance is below that bound search, and only blocks in reach.
* ``condense``: edges in ascending order, in slices whose connected parts fit one task each. Equal distances merge at once, so
  the result does not depend on which of several equal edges the tree holds.
* ``outermost``: each condensed cluster finds the chosen cluster furthest up, by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.neighbours import _SLACK, VectorBlocks, _distances, _matrix, connected_components, knn_graph
from threadlens.session import materialize

#: Shortest distance told apart; similarities are rounded to 12 digits, so chords below it are noise.
SHORTEST = 1e-6


def _chord(sim):
    """Chord of two unit vectors from their similarity."""
    return np.round(np.sqrt(np.maximum(2.0 - 2.0 * np.round(sim, 12), 0.0)), 9)


def _chord_col(sim):
    return F.round(F.sqrt(F.greatest(2.0 - 2.0 * sim, F.lit(0.0))), 9)


def reachability(df: DataFrame, vb: VectorBlocks, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their core distance, and the mutual reachability of each with its nearest ones.

    Empty when the table has fewer than ``min_points`` rows with a direction.
    """
    graph = knn_graph(df, min_points - 1, index=vb).join(
        vb.blocks.select(F.col("rep").alias("id")), "id", "left_semi"
    ).withColumn("d", _chord_col(F.col("similarity")))
    graph = materialize(graph, "near")
    core = graph.filter(F.col("rank") == min_points - 1).select(F.col("id").alias("rep"), F.col("d").alias("far"))
    points = materialize(vb.blocks.drop("radius").join(core, "rep"), "points")
    own = points.select(F.col("rep").alias("a"), F.col("far").alias("fa"))
    other = points.select(F.col("rep").alias("b"), F.col("far").alias("fb"))
    pairs = graph.select(F.col("id").alias("a"), F.col("neighbor").alias("id"), "d").join(vb.rows, "id").select(
        "a", F.col("rep").alias("b"), "d"
    ).filter("a <> b").distinct().join(own, "a").join(other, "b").select("a", "b", F.greatest("d", "fa", "fb").alias("w"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct()
    return points, materialize(both, "near-edges")


def _bounds(rows: DataFrame, vb: VectorBlocks, cells: list) -> DataFrame:
    """Per component a distance within which some row of another component is known to be.

    All of a cell lies within its outer radius of the pivot, so a cell that holds another component is such a proof.
    """
    pivots, outer = vb.pivots, vb.outer
    least, most = np.full(len(pivots), None, dtype=object), np.full(len(pivots), None, dtype=object)
    far = np.full(len(pivots), np.inf)
    for r in cells:
        least[r["cell"]], most[r["cell"]], far[r["cell"]] = r["least"], r["most"], r["far_most"]

    def bound(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                label = part["label"].to_numpy(dtype=object)[:, None]
                reach = np.maximum(_distances(_matrix(part["vec"]), pivots) + outer, far)
                reach = np.maximum(reach, part["far"].to_numpy()[:, None])
                only_own = ((least == label) & (most == label)).astype(bool)
                reach[only_own] = np.inf
                yield part[["label"]].assign(proven=reach.min(axis=1)).groupby("label", as_index=False).min()

    found = rows.select("vec", "label", "far").mapInPandas(bound, f"label {vb.id_type}, proven double")
    return found.groupBy("label").agg(F.min("proven").alias("proven"))


def _other_components(cells: list, count: int):
    """Which cells in reach of a row hold rows of other components, near enough to others of their own."""
    filler = cells[0]["least"]
    least, most, far = [filler] * count, [filler] * count, np.full(count, np.inf)
    for r in cells:
        least[r["cell"]], most[r["cell"]], far[r["cell"]] = r["least"], r["most"], r["far_least"]
    least, most = np.array(least), np.array(most)

    def wanted(rows, bound, at):
        reach, label = rows["reach"].to_numpy()[:, None], rows["label"].to_numpy()[:, None]
        mixed = (least[at] != most[at]) | (least[at] != label)
        return (bound <= reach + _SLACK) & mixed & (far[at] <= reach)

    return wanted


def spanning_edges(points: DataFrame, near: DataFrame, vb: VectorBlocks) -> DataFrame:
    """Edges (a, b, w) whose components at every distance are those of all pairs; fewer than two per point.

    Rounds go on until one component is left, at most the logarithm of the number of points.
    """
    spark, kind = points.sparkSession, vb.id_type
    state = materialize(points.select("rep", F.col("rep").alias("label")), "components")
    taken = []

    def nearest(visitors, q, met, memory):
        """The lightest edge from each component to another one, as far as it can be of use."""
        far, label, reach = (visitors[c].to_numpy() for c in ("far", "label", "reach"))
        floor, out = 1.0 - reach * reach / 2 - _SLACK, []
        for block, who in met:
            own, theirs = block.rows["far"].to_numpy(), block.rows["label"].to_numpy()
            sim = q[who] @ block.m.T
            i, j = np.nonzero((sim >= floor[who][:, None]) & (own <= reach[who][:, None]))
            other = label[who[i]] != theirs[j]
            i, j, v = i[other], j[other], who[i[other]]
            w = np.maximum(np.maximum(_chord(sim[i, j]), far[v]), own[j])
            light = np.lexsort((w, v))
            light = light[np.unique(v[light], return_index=True)[1]]  # one of the lightest of each visitor
            out.append(pd.DataFrame({
                "label": label[v[light]], "w": w[light], "a": visitors["rep"].to_numpy()[v[light]],
                "b": block.rows["rep"].to_numpy()[j[light]], "other": theirs[j[light]],
            }))
        return pd.concat(out).sort_values("w").drop_duplicates("label")

    edge = f"label {kind}, w double, a {kind}, b {kind}, other {kind}"
    while True:
        rows = materialize(points.join(state, "rep"), "labelled")
        per_cell = rows.groupBy("cell").agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.min("far").alias("far_least"),
            F.max("far").alias("far_most"),
        )
        cells = per_cell.collect()  # one row per pivot
        if len({r["least"] for r in cells} | {r["most"] for r in cells}) < 2:
            break
        near = near.select("a", "b", "w").join(state.select(F.col("rep").alias("a"), "label"), "a").join(
            state.select(F.col("rep").alias("b"), F.col("label").alias("other")), "b"
        ).filter(F.col("label") != F.col("other"))
        near = materialize(near.select("label", "w", "a", "b", "other"), "crossing")
        listed = near.groupBy("label").agg(F.min("w").alias("listed"))
        limit = _bounds(rows, vb, cells).join(listed, "label", "left")
        limit = limit.withColumn("reach", F.least("proven", "listed"))
        # A listed edge is already as light as any that starts at a row of no smaller core distance.
        useful = (F.col("far") < F.col("reach")) | (
            (F.col("listed").isNull() | (F.col("listed") > F.col("reach"))) & (F.col("far") <= F.col("reach"))
        )
        asking = rows.join(limit, "label").filter(useful)
        carried = {"far": "double", "label": kind}
        found = vb.scan(rows, asking, nearest, edge, carried, _other_components(cells, len(vb.pivots)))
        best = near.unionByName(found).groupBy("label").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
        best = materialize(best.select("label", "e.*"), "lightest")
        taken.append(best.select("a", "b", "w"))
        joined = connected_components(best.select(F.col("label").alias("a"), F.col("other").alias("b")))
        state = materialize(
            state.withColumnRenamed("label", "node").join(joined, "node").select("rep", "label"), "components"
        )
    if not taken:
        return spark.createDataFrame([], f"a {kind}, b {kind}, w double")
    return reduce(DataFrame.unionByName, taken)


def _merge(nodes: pd.DataFrame, edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """Merge the components of one part along its edges, lightest first, keeping track of clusters."""
    parts = nodes.sort_values("comp").to_dict("records")
    at = {p["comp"]: i for i, p in enumerate(parts)}
    up, out = list(range(len(parts))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def settle(part: dict, cluster: str) -> None:
        out.extend({"kind": "member", "comp": m, "cluster": cluster} for m in part["members"])
        part["members"] = []

    def combine(old: list[int], w: float) -> dict:
        group = [parts[i] for i in old]
        big = [p for p in group if isinstance(p["cluster"], str)]
        size, density = sum(p["size"] for p in group), 1.0 / max(w, SHORTEST)
        whole = {"comp": min(p["comp"] for p in group), "size": size, "cluster": None, "total": 0.0, "kids": 0.0,
                 "members": []}
        if len(big) == 1:
            whole |= {k: big[0][k] for k in ("cluster", "total", "kids")}
            whole["total"] += (size - big[0]["size"]) * density
        elif size >= min_size:
            whole |= {"cluster": f"{w!r}:{whole['comp']}", "total": size * density}
            for p in big:
                stability = max(0.0, p["total"] - p["size"] * density)
                whole["kids"] += max(stability, p["kids"])
                out.append({"kind": "closed", "cluster": p["cluster"], "parent": whole["cluster"],
                            "stability": stability, "chosen": stability >= p["kids"]})
        for p in group:
            if whole["cluster"] is None:
                whole["members"] = whole["members"] + list(p["members"])
            else:
                settle(p, whole["cluster"])
        return whole

    edges = edges.sort_values("w")
    for w, run in edges.groupby("w", sort=False):
        merged: dict[int, list[int]] = {}
        for a, b in zip(run["a"], run["b"]):
            x, y = sorted((root(at[a]), root(at[b])))
            if x != y:
                up[y] = x
                merged.setdefault(x, [x]).extend(merged.pop(y, [y]))
        for top, old in merged.items():
            parts[top] = combine(old, float(w))
    names = list(at)
    for i, name in enumerate(names):
        out.append({"kind": "moved", "comp": name, "to": names[root(i)]})
        if up[i] == i:
            out.append({"kind": "state", **parts[i]})
    made = pd.DataFrame(out, columns=[
        "kind", "comp", "to", "size", "cluster", "total", "kids", "members", "parent", "stability", "chosen"], dtype=object)
    return made.where(made.notna(), None)


def condense(
    points: DataFrame, edges: DataFrame, kind: str, min_cluster_size: int, task_edges: int = 200_000,
) -> tuple[DataFrame, DataFrame]:
    """Condensed tree: clusters (cluster, parent, stability, chosen) and members (rep, cluster).

    A part of ``min_cluster_size`` rows or more is a cluster; where two or more of them meet, they end and a new one begins. A
    cluster is chosen if it is at least as stable as the best choice below it; the one that holds everything never is.
    A point is a member of the first cluster it is in; points of no cluster are missing. Edges are taken in slices
    whose connected parts have ``task_edges`` edges at most, unless more edges than that have one and the same distance.
    """
    is_big = F.col("weight") >= min_cluster_size
    start = points.select(
        F.col("rep").alias("comp"), F.col("weight").alias("size"),
        F.when(is_big, F.concat_ws(":", F.col("far").cast("string"), F.col("rep").cast("string"))).alias("cluster"),
        F.when(is_big, F.col("weight") / F.greatest("far", F.lit(SHORTEST))).otherwise(0.0).alias("total"),
        F.lit(0.0).alias("kids"), F.when(~is_big, F.array("rep")).otherwise(F.array().cast(f"array<{kind}>")).alias("members"),
    )
    states = materialize(start, "parts")
    members = [states.filter(F.col("cluster").isNotNull()).select(F.col("comp").alias("rep"), "cluster")]
    closed = []
    schema = (
        f"kind string, comp {kind}, to {kind}, size long, cluster string, total double, kids double, "
        f"members array<{kind}>, parent string, stability double, chosen boolean"
    )
    rest, share = materialize(edges.distinct(), "tree-edges"), 1.0
    while left := rest.count():
        share = min(1.0, 2 * share)
        while True:
            if left <= task_edges:
                part = rest.withColumn("part", F.lit(None).cast(kind))
                touched = states.withColumn("part", F.lit(None).cast(kind))
                break
            cut = rest.approxQuantile("w", [share], 0.0001)[0] if share < 1 else float("inf")
            part = rest.filter(F.col("w") <= cut)
            names = connected_components(part.select("a", "b")).withColumnRenamed("label", "part")
            part = materialize(part.join(names.withColumnRenamed("node", "a"), "a"), "slice")
            widest = part.groupBy("part").count().agg(F.max("count")).first()[0]
            if widest <= task_edges or share * left <= task_edges:
                touched = states.join(names.withColumnRenamed("node", "comp"), "comp")
                break
            share /= 2
        done = touched.groupBy("part").cogroup(part.groupBy("part")).applyInPandas(
            lambda nodes, run: _merge(nodes, run, min_cluster_size), schema)
        done = materialize(done, "merged")
        moved = done.filter("kind = 'moved'").select(F.col("comp").alias("node"), "to")
        members.append(done.filter("kind = 'member'").select(F.col("comp").alias("rep"), "cluster"))
        closed.append(done.filter("kind = 'closed'").select("cluster", "parent", "stability", "chosen"))
        now = done.filter("kind = 'state'").select("comp", "size", "cluster", "total", "kids", "members")
        kept = states.join(moved.withColumnRenamed("node", "comp"), "comp", "left_anti")
        states = materialize(kept.unionByName(now), "parts")
        if left <= task_edges:
            break
        for end in ("a", "b"):
            rest = rest.join(moved.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("to", end)).drop("to")
        rest = materialize(rest.filter((F.col("w") > cut) & (F.col("a") != F.col("b"))), "tree-edges")
    closed.append(states.filter(F.col("cluster").isNotNull()).select(
        "cluster", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("stability"), F.lit(False).alias("chosen")))
    return materialize(reduce(DataFrame.unionByName, closed), "tree"), reduce(DataFrame.unionByName, members)


def outermost(tree: DataFrame) -> DataFrame:
    """(cluster, top): the chosen cluster furthest up from each, itself included; null if there is none."""
    t = materialize(tree.select("cluster", F.col("parent").alias("above"), F.when(F.col("chosen"), F.col("cluster")).alias("top")), "climb")
    while t.filter(F.col("above").isNotNull()).limit(1).count():
        over = t.select(F.col("cluster").alias("above"), F.col("above").alias("next"), F.col("top").alias("higher"))
        t = materialize(t.join(over, "above", "left").select(
            "cluster", F.col("next").alias("above"), F.coalesce("higher", "top").alias("top")), "climb")
    return t.select("cluster", "top")


def density_hierarchy(
    df: DataFrame, min_points: int = 5, min_cluster_size: int = 50, id_col: str = "id", vec: str = "embedding",
    task_edges: int = 200_000, **blocks,
) -> DataFrame:
    """Hierarchical density clusters by cosine, without a radius to choose.

    Columns: id, cluster_id (least id of the cluster, -1 for noise), stability. Ids are unique and not null. Rows without a
    direction, and all rows where there are fewer than ``min_points``, are noise. Copies count as so many rows.
    """
    if min_points < 2 or min_cluster_size < 2:
        raise ValueError("min_points and min_cluster_size are at least 2")
    df = df.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"))
    vb = VectorBlocks(df, **blocks)
    points, near = reachability(df, vb, min_points)
    tree, members = condense(points, spanning_edges(points, near, vb), vb.id_type, min_cluster_size, task_edges)
    found = members.join(outermost(tree), "cluster").filter(F.col("top").isNotNull()).select("rep", "top")
    placed = materialize(vb.rows.join(found, "rep", "left").select("id", "top"), "placed")
    named = placed.filter(F.col("top").isNotNull()).groupBy("top").agg(F.min("id").alias("cluster_id")).join(
        tree.select(F.col("cluster").alias("top"), "stability"), "top")
    noise = F.lit(-1).cast(vb.id_type)
    return placed.join(named, "top", "left").select("id", F.coalesce("cluster_id", noise).alias("cluster_id"), "stability").unionByName(
        vb.without_direction.select("id", noise.alias("cluster_id"), F.lit(None).cast("double").alias("stability")))
