"""Exact cosine neighbours and density clusters without comparing every pair.

Unit vectors are grouped into cells around pivots (after Lu et al. 2012, k nearest neighbour joins by
pivot partitioning). The triangle inequality gives, per vector, the cells that can hold something
close enough; only those are compared. Cells are split by hash into blocks of bounded size, and blocks are
gathered into regions, one task each: a vector is sent once to each region it has to see, not once to each block,
and regions only become more when the table outgrows their rows. Identical vectors are collapsed first and expanded
at the end, so a group of copies is one vector to the search. Inside a task blocks are compared with matrix
products and only the few best rows, a count or a spanning set of links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ranking import small_side, top_n_per_group
from threadlens.operators.sampling import random_cap_sample
from threadlens.session import materialize

_SLACK = 1e-9
_CHUNK = 1024
#: Regions of a small table, and the rows from which on a larger one has more of them.
_REGIONS = 24
_REGION_ROWS = 32_768


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("float64")


def unit_rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, digest, vector of length one); a zero or missing vector has no direction and gives null."""
    v = F.col(vec).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(F.col("__len") > 0, F.transform("__v", lambda x: x / F.col("__len")))
    rows = df.select(F.col(id_col).alias("id"), v.alias("__v"), length.alias("__len"))
    digest = F.sha2(F.array_join(F.col("__v").cast("array<string>"), ",").cast("binary"), 256)
    return rows.select("id", digest.alias("digest"), unit.alias("vec"))


class VectorBlocks:
    """Distinct unit vectors in blocks, with what is needed to decide which blocks to visit.

    ``rows`` maps every id to its representative; ``blocks`` holds one row per distinct vector with
    ``weight`` copies. The driver keeps the pivots and three numbers per cell.
    """

    def __init__(
        self, df: DataFrame, id_col: str = "id", vec: str = "embedding", pivots: int | None = None,
        block_rows: int = 4096, seed: int = 42,
    ):
        units = materialize(unit_rows(df, id_col, vec), "units")
        self.without_direction = units.filter(F.col("vec").isNull()).select("id")
        units = units.filter(F.col("vec").isNotNull())
        self.id_type = units.schema["id"].dataType.simpleString()
        groups = units.groupBy("digest").agg(
            F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"), F.count("*").alias("weight")
        )
        reps = materialize(groups, "distinct-vectors")
        self.rows = units.select("id", "digest").join(reps.select("digest", "rep"), "digest").select(
            "id", "rep"
        )
        n = reps.count()
        # Cells of about a block each while the pivots stay a small driver-side matrix.
        count = pivots or min(1024, max(1, math.ceil(math.sqrt(n) / 2)))
        sample = random_cap_sample(reps.select("rep", "vec"), count, "rep", seed).select("vec")
        found = [r["vec"] for r in sample.collect()] or [[0.0]]  # no rows: one pivot that nothing is placed at
        self.pivots = np.array(found, dtype="float64").reshape(len(found), -1)
        placed = materialize(self._assign(reps), "cells")
        stats = placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
        ).collect()
        p = len(self.pivots)
        self.inner, self.outer = np.full(p, np.inf), np.full(p, -np.inf)
        self.n_blocks, self.sizes = np.zeros(p, dtype=int), np.zeros(p, dtype=int)
        for r in stats:
            self.sizes[r["cell"]] = r["n"]
            self.inner[r["cell"]], self.outer[r["cell"]] = r["lo"], r["hi"]
            self.n_blocks[r["cell"]] = math.ceil(r["n"] / block_rows)
        split = F.array(*[F.lit(int(max(b, 1))) for b in self.n_blocks])
        self.blocks = placed.withColumn(
            "block", F.pmod(F.xxhash64("rep"), split[F.col("cell")]).cast("int")
        )

    def _assign(self, reps: DataFrame) -> DataFrame:
        pivots = self.pivots

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    dist = _distances(_matrix(pdf["vec"]), pivots)
                    cell = dist.argmin(axis=1)
                    yield pdf.assign(
                        cell=cell.astype("int32"), radius=dist[np.arange(len(pdf)), cell]
                    )

        schema = f"rep {self.id_type}, vec array<double>, weight long, cell int, radius double"
        return reps.select("rep", "vec", "weight").mapInPandas(nearest, schema)

    def bounds(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function for tasks: how near a row of each of some cells can be to each row of a matrix at least."""
        pivots, inner, outer = self.pivots, self.inner, self.outer

        def bound(m: np.ndarray, cells: np.ndarray) -> np.ndarray:
            dist = _distances(m, pivots[cells])
            return np.maximum(dist - outer[cells], inner[cells] - dist)

        return bound

    def regions(self, region_rows: int = _REGION_ROWS) -> np.ndarray:
        """Region of each block, blocks counted cell by cell; cells of one region are near each other."""
        order, left = [0], np.ones(len(self.pivots), dtype=bool)
        left[0] = False
        while left.any():
            dist = np.where(left, _distances(self.pivots[order[-1:]], self.pivots)[0], np.inf)
            order.append(int(dist.argmin()))
            left[order[-1]] = False
        first = np.cumsum(self.n_blocks) - self.n_blocks
        blocks = np.concatenate([first[c] + np.arange(self.n_blocks[c]) for c in order]).astype(int)
        rows = np.concatenate([np.full(self.n_blocks[c], self.sizes[c] / max(1, self.n_blocks[c])) for c in order])
        count = min(len(blocks), max(_REGIONS, math.ceil(self.sizes.sum() / region_rows)))
        found = np.zeros(len(blocks), dtype=int)
        middle = (np.cumsum(rows) - rows / 2) / max(1.0, rows.sum())
        found[blocks] = np.minimum((middle * count).astype(int), count - 1)
        return found

    def visits(
        self, queries: DataFrame, skip_own: bool, carry: dict[str, str] | None = None, wanted: Callable | None = None,
        region_rows: int = _REGION_ROWS,
    ) -> DataFrame:
        """One row per (query, region to visit); ``reach`` is how far a useful partner may be.

        A region is left out only when the triangle inequality puts all of its cells beyond reach. ``carry`` names further
        columns, with their types, that the visitor takes along. ``wanted`` decides from the rows, the bounds of cells and
        the cells which of them are needed, where reach is not all. ``skip_own`` leaves out the region of the query.
        """
        cols = ["rep", "vec", "weight", "cell", "block", "reach", *(carry or {"core": "boolean"})]
        region, first, full = self.regions(region_rows), np.cumsum(self.n_blocks) - self.n_blocks, self.n_blocks > 0
        cells = np.flatnonzero(full)
        holds = np.zeros((len(self.pivots), region.max(initial=0) + 1), dtype="float32")
        holds[np.repeat(np.arange(len(self.pivots)), self.n_blocks), region] = 1
        holds, wanted, bounds = holds[cells], wanted or _within_reach, self.bounds()

        @F.pandas_udf("array<int>")
        def reached(pdf: pd.DataFrame) -> pd.Series:
            out = []
            for start in range(0, len(pdf), _CHUNK):
                part = pdf.iloc[start:start + _CHUNK]
                near = wanted(part, bounds(_matrix(part["vec"]), cells), cells)
                hit = near.astype("float32") @ holds > 0
                if skip_own:
                    hit[np.arange(len(part)), region[first[part["cell"]] + part["block"]]] = False
                out += [np.flatnonzero(h).astype("int32") for h in hit]
            return pd.Series(out, dtype=object)

        return queries.select(*cols).withColumn("region", F.explode(reached(F.struct(*cols))))

    def scan(
        self, data: DataFrame, queries: DataFrame, kernel: Callable, schema: str, carry: dict[str, str] | None = None,
        wanted: Callable | None = None, finish: Callable | None = None, region_rows: int = _REGION_ROWS,
    ) -> DataFrame:
        """Stream the visiting rows of each region past the blocks of the region.

        Rows are co-partitioned by region and sorted with the region's own rows first. A task holds one region, so many
        rows at most as a region has, and one batch of visitors at a time. ``kernel`` gets the visitors, their matrix, the blocks they
        have to see with the visitors that do, and a dictionary that lasts as long as the region; ``finish`` gets it at the end.
        """
        carry = carry or {"core": "boolean"}
        cols = ["rep", "vec", "weight", "cell", "block", "reach", *carry]
        region, first = self.regions(region_rows), np.cumsum(self.n_blocks) - self.n_blocks
        place = F.expr(f"array({','.join(map(str, region))})")[
            F.expr(f"array({','.join(map(str, first))})")[F.col("cell")] + F.col("block")]
        own = data.withColumn("reach", F.lit(0.0)).select(*cols, place.cast("int").alias("region"), F.lit(0).alias("role"))
        visits = self.visits(queries, False, carry, wanted, region_rows)
        both = own.unionByName(visits.select(*cols, "region", F.lit(1).alias("role")))
        ordered = both.repartitionById(int(region.max(initial=0)) + 1, "region").sortWithinPartitions(
            "region", "role", "cell", "block")
        wanted, bounds = wanted or _within_reach, self.bounds()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, parts, held, memory = None, [], None, {}
            for pdf in batches:
                code = pdf[["region", "role"]].to_numpy()
                if not len(code):
                    continue
                cuts = np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(code)]):
                    segment = pdf.iloc[lo:hi]
                    if code[lo][0] != key:
                        if finish and held:
                            yield from finish(memory)
                        key, parts, held, memory = code[lo][0], [], None, {}
                    if code[lo][1] == 0:
                        parts.append(segment)
                    elif parts:
                        if held is None:
                            held = _held(parts)
                            memory["reps"] = np.concatenate([b.rows["rep"].to_numpy() for b in held])
                            cells, parts = np.array([b.cell for b in held]), [None]
                        for at in range(0, len(segment), _CHUNK):
                            visitors = segment.iloc[at:at + _CHUNK]
                            q = _matrix(visitors["vec"])
                            near = wanted(visitors, bounds(q, cells), cells)
                            met = [(b, np.flatnonzero(n)) for b, n in zip(held, near.T) if n.any()]
                            out = kernel(visitors, q, met, memory) if met else None
                            if out is not None and len(out):
                                yield out
            if finish and held:
                yield from finish(memory)

        return ordered.mapInPandas(run, schema)


@dataclass
class Block:
    """Rows of one block in a task: the first is row ``at`` of the region."""

    cell: int
    at: int
    rows: pd.DataFrame
    m: np.ndarray


def _held(parts: list[pd.DataFrame]) -> list[Block]:
    """The blocks of a region; its rows come sorted by cell and block."""
    rows = pd.concat(parts, ignore_index=True)
    m = _matrix(rows["vec"])
    rows = rows.drop(columns="vec")
    code = rows[["cell", "block"]].to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1
    return [Block(int(code[lo][0]), int(lo), rows.iloc[lo:hi], m[lo:hi]) for lo, hi in zip([0, *cuts], [*cuts, len(code)])]


def _within_reach(rows: pd.DataFrame, bound: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return bound <= rows["reach"].to_numpy()[:, None] + _SLACK


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class _Lists:
    """The k best partners of each row of a block so far, ties going to the smaller id.

    Finds are put aside and merged when there are as many as the lists hold. ``floor`` is what a find must reach.
    """

    def __init__(self, block: Block, k: int):
        self.block, self.k, self.reps = block, k, block.rows["rep"].to_numpy()
        self.floor = block.rows["floor"].fillna(-np.inf).to_numpy().copy()
        self.best = (np.empty(0, dtype=int), np.empty(0), self.reps[:0])
        self.aside, self.waiting, self.room = [], 0, max(k * len(self.reps), 200_000)

    def offer(self, bounds: Callable, q: np.ndarray, ids: np.ndarray, homes: np.ndarray) -> None:
        reach = _distances_from(np.maximum(self.floor, -1.0))[:, None] + _SLACK
        rows = np.flatnonzero((bounds(self.block.m, np.unique(homes)) <= reach).any(axis=1))
        if not len(rows):
            return
        sim = self.block.m[rows] @ q.T
        i, j = np.nonzero(sim >= self.floor[rows][:, None] - _SLACK)
        found = np.round(sim[i, j], 12)
        i = rows[i]
        other = (found >= self.floor[i]) & ((ids[j] != self.reps[i]) | (found < 1.0 - _SLACK))
        self.aside.append((i[other], found[other], ids[j[other]]))
        self.waiting += int(other.sum())
        if self.waiting > self.room:
            self.merge()

    def merge(self) -> None:
        row, sim, ids = (np.concatenate(x) for x in zip(self.best, *self.aside))
        order_of = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((order_of, -sim, row))
        start = np.searchsorted(row[order], np.arange(len(self.reps)))
        rank = np.arange(len(order)) - start[row[order]]
        keep = order[rank < self.k]
        self.best = row[keep], sim[keep], ids[keep]
        last = order[rank == self.k - 1]
        self.floor[row[last]] = sim[last]
        self.aside, self.waiting = [], 0

    def result(self) -> pd.DataFrame:
        self.merge()
        row, sim, ids = self.best
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pd.DataFrame({"rep": self.reps[row], "rank": rank.astype("int32"), "other": ids, "similarity": sim})


def knn_graph(
    df: DataFrame, k: int = 15, id_col: str = "id", vec: str = "embedding", index: VectorBlocks | None = None, **blocks,
) -> DataFrame:
    """The k nearest rows of every row by cosine, exact, ties going to the smaller id.

    Columns: id, rank, neighbor, similarity. A zero vector has no direction, hence no neighbours.
    ``index`` is given when the blocks of ``df`` exist already.
    """
    vb = index or VectorBlocks(df, id_col, vec, **blocks)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """The k-th best similarity inside the own block, which bounds how far a better neighbour can be."""
        m, floor = _matrix(pdf["vec"]), np.full(len(pdf), np.nan)
        if len(m) > k:
            for at in range(0, len(m), _CHUNK):
                sim = np.round(m[at:at + _CHUNK] @ m.T, 12)
                sim[np.arange(len(sim)), at + np.arange(len(sim))] = -np.inf
                floor[at:at + len(sim)] = np.partition(sim, -k, axis=1)[:, -k]
        return pdf.assign(floor=floor)

    bounded = materialize(vb.blocks.select("rep", "vec", "weight", "cell", "block").groupBy("cell", "block").applyInPandas(
        inside, f"rep {vb.id_type}, vec array<double>, weight long, cell int, block int, floor double"), "bounded")
    bounded = bounded.withColumn("floor", F.nanvl("floor", F.lit(None).cast("double")))
    reach = F.when(F.col("floor").isNull(), F.lit(2.0)).otherwise(
        F.sqrt(F.greatest(2.0 - 2.0 * F.col("floor"), F.lit(0.0)))
    )
    cell_reach = np.zeros(len(vb.pivots))
    for r in bounded.groupBy("cell").agg(F.max(reach).alias("reach")).collect():  # one row per pivot
        cell_reach[r["cell"]] = r["reach"]

    bounds = vb.bounds()

    def wanted(rows, bound, cells):
        """The blocks search, so a row goes where the widest search of a cell can meet it."""
        return bound <= cell_reach[cells] + _SLACK

    def search(visitors, q, met, memory):
        ids, homes = visitors["rep"].to_numpy(), visitors["cell"].to_numpy()
        lists = memory.setdefault("lists", {})
        for block, who in met:
            if block.at not in lists:
                lists[block.at] = _Lists(block, k)
            lists[block.at].offer(bounds, q[who], ids[who], homes[who])

    def finish(memory):
        for lists in memory.get("lists", {}).values():
            yield lists.result()

    searching = bounded.withColumn("reach", F.lit(0.0))
    # Long lists take more room than the vectors, so their regions have fewer rows.
    best = vb.scan(
        searching, searching, search, f"rep {vb.id_type}, rank int, other {vb.id_type}, similarity double",
        {"floor": "double"}, wanted, finish, min(_REGION_ROWS, max(1, 8_000_000 // k)),
    )
    rows = materialize(vb.rows, "rows")
    if rows.count() == rows.select("rep").distinct().count():
        return best.filter(F.col("rep").isNotNull() & F.col("other").isNotNull()).select(
            F.col("rep").alias("id"), "rank", F.col("other").alias("neighbor"), "similarity")
    best = top_n_per_group(best.drop("rank"), "rep", [F.desc("similarity"), F.asc("other")], k, "other", salts=1)
    # Copies: every representative of several stands for its smallest k + 1 ids, which is all a list can use.
    several = rows.join(rows.groupBy("rep").count().filter("count > 1").select("rep"), "rep", "left_semi")
    copies = small_side(top_n_per_group(several, "rep", [F.asc("id")], k + 1, "id"), "copies")
    expanded = best.filter(F.col("other").isNotNull()).join(
        copies.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left")
    own = copies.select("rep", F.col("id").alias("neighbor"), F.lit(1.0).alias("similarity"))
    lists = top_n_per_group(
        expanded.select("rep", F.coalesce("copy", "other").alias("neighbor"), "similarity").unionByName(own), "rep",
        [F.desc("similarity"), F.asc("neighbor")], k + 1, "neighbor", salts=1,
    ).groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbor"))).alias("all")
    )
    per_row = rows.join(lists, "rep")
    others = F.slice(F.filter("all", lambda x: x["neighbor"] != F.col("id")), 1, k)
    return per_row.select("id", F.posexplode(others).alias("rank", "x")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("x.neighbor").alias("neighbor"),
        (-F.col("x.s")).alias("similarity"),
    )


def _at_least(sim: np.ndarray, limit: float) -> np.ndarray:
    """Whether similarities, rounded to twelve digits, reach the limit; only those next to it are rounded."""
    close = sim >= limit - _SLACK
    i, j = np.nonzero(close & (sim < limit + _SLACK))
    close[i, j] = np.round(sim[i, j], 12) >= limit
    return close


def _distances_from(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of an undirected edge table (a, b).

    Each round takes the smallest label among the neighbours and then jumps to the label's own
    label, so long chains shrink quickly; rounds go on until no label changes. Every round is written to the shared folder, which cuts
    the lineage and survives lost executors.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = materialize(labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = step.join(jump, "next").select(
            "node", F.least("next", "beyond").alias("label"),
            (F.least("next", "beyond") != F.col("label")).alias("changed"),
        )
        moved = materialize(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.filter("changed").limit(1).count():
            return labels


def density_clusters(
    df: DataFrame, min_similarity: float, min_points: int = 10, min_cluster_size: int = 50,
    id_col: str = "id", vec: str = "embedding", **blocks,
) -> DataFrame:
    """Density clusters: cores with enough close rows, joined when close; small clusters are noise.

    A row belongs to the cluster of its nearest close core. ``cluster_id`` is the smallest core id
    of the cluster, or -1. Columns: id, cluster_id.
    """
    vb = VectorBlocks(df, id_col, vec, **blocks)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * min_similarity))
    everyone = vb.blocks.withColumn("reach", F.lit(reach)).withColumn("core", F.lit(True))
    limit = round(min_similarity, 12)

    def count_close(visitors, q, met, memory):
        close = np.zeros(len(q), dtype="int64")
        for block, who in met:
            near, weight = _at_least(q[who] @ block.m.T, limit), block.rows["weight"].to_numpy()
            several = np.flatnonzero(weight > 1)
            close[who] += np.count_nonzero(near, axis=1) + near[:, several] @ (weight[several] - 1)
        return pd.DataFrame({"rep": visitors["rep"].to_numpy(), "close": close})

    counted = vb.scan(everyone, everyone, count_close, f"rep {vb.id_type}, close long").groupBy("rep").agg(
        F.sum("close").alias("close"))
    flagged = vb.blocks.join(counted, "rep").withColumn("core", F.col("close") >= min_points)
    flagged = materialize(flagged.withColumn("reach", F.lit(reach)).drop("close", "radius"), "cores")
    cores = flagged.filter("core")

    def link(visitors, q, met, memory):
        """Links that keep the region's close cores connected, not every close pair; others name their nearest core."""
        reps, names = memory["reps"], visitors["rep"].to_numpy()
        is_core = visitors["core"].to_numpy(dtype=bool)
        group = memory.setdefault("group", np.arange(len(reps)))
        tied, nearest, out = np.full(len(q), -1), {}, []
        for block, who in met:
            sim = q[who] @ block.m.T
            close = _at_least(sim, limit)
            hit = close.any(axis=1)
            for v in np.flatnonzero(hit & ~is_core[who]):
                at = np.flatnonzero(close[v])
                s = np.round(sim[v, at], 12)
                top = (-s.max(), min(reps[block.at + at[s == s.max()]]))
                nearest[who[v]] = min(nearest.get(who[v], top), top)
            hits = np.flatnonzero(hit & is_core[who])
            mine = group[block.at:block.at + len(block.rows)]
            if not len(hits):
                continue
            if (mine == mine[0]).all():
                low = high = np.full(len(hits), mine[0])
            else:
                low = np.where(close[hits], mine, len(reps)).min(axis=1)
                high = np.where(close[hits], mine, -1).max(axis=1)
            new = tied[who[hits]] < 0
            out += [(a, b, 1.0, True) for a, b in zip(names[who[hits[new]]], reps[low[new]])]
            tied[who[hits[new]]] = low[new]
            for v in hits[(low != high) | (group[tied[who[hits]]] != low)]:
                found = np.unique(np.append(mine[close[v]], group[tied[who[v]]]))
                for g in found[1:]:
                    out.append((reps[g], reps[found[0]], 1.0, True))
                    group[group == g] = found[0]
        out += [(names[v], b, -s, False) for v, (s, b) in nearest.items()]
        return pd.DataFrame(out, columns=["a", "b", "similarity", "core"])

    links = vb.scan(
        cores, flagged, link, f"a {vb.id_type}, b {vb.id_type}, similarity double, core boolean",
    )
    links = materialize(links, "links")
    labels = connected_components(links.filter("core"))
    border = links.filter(~F.col("core")).groupBy("a").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("m")
    ).select(F.col("a").alias("rep"), F.col("m.b").alias("node"))
    placed = border.join(labels, "node").select("rep", "label").unionByName(
        labels.select(F.col("node").alias("rep"), "label")
    )
    rows = vb.rows.join(placed, "rep", "left").select("id", "label")
    size = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    big = size.filter(F.col("n") >= min_cluster_size).select("label", F.col("label").alias("cluster_id"))
    noise = F.lit(-1).cast(vb.id_type)
    return rows.join(big, "label", "left").select(
        "id", F.coalesce("cluster_id", noise).alias("cluster_id")
    ).unionByName(vb.without_direction.select("id", noise.alias("cluster_id")))


def neighbour_sweep(graph: DataFrame, sizes: list[int]) -> DataFrame:
    """Edges and mean similarity at each neighbourhood size, all from one graph of the largest."""
    each = graph.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes])))
    return each.filter(F.col("rank") <= F.col("k")).groupBy("k").agg(
        F.count("*").alias("n_edges"), F.avg("similarity").alias("mean_similarity")
    )
