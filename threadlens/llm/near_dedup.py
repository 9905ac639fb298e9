"""Near-duplicate classes by Order MinHash and banded alignment.

Texts that are equal up to white space are one node from the start. A node's shingles of five words are
labelled with their occurrence number; for each hash function the two least shingles are kept in the order
of the text, and hashes of such pairs are grouped into bands. Nodes that share a band are candidates.

Bands of up to ``TASK_MEMBERS`` nodes are gathered by their least node into cells, so a text travels once to the bands that it shares with
the same others. A cell is settled inside one task: an index over the rarest shingles of each text finds all pairs that can reach the
threshold, and of those only pairs that are in different components so far are aligned.

Larger bands name their least node as centre, every member is aligned with it, and members that fail form a new bucket with a new
centre, for as long as that resolves a good part of them. Then they are looked at again with the components found so far: their nodes are
cut into blocks, and what is in different components meets in cells (``_across``), which are settled in the same way. Every pair of nodes
that share a band is therefore in one class or surely below the threshold, however many rounds there were.

A link needs a similarity of at least ``threshold``: shingles inside runs of words that the alignment
matches in order, over all shingles of both texts. The alignment's band is as wide as the threshold allows
edits. Classes are connected components of the links.

Edge cases: null counts as empty, and empty texts are one class. A text of fewer than five words is one
shingle. Rows that repeat are members of one class; a class is named by its least id, or null if it has
null ids only. Texts are compared whole. Other columns do not take part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.exact_dedup import HEAVY_GROUPS, collapse_spaces, mark_possible_repeats
from threadlens.operators.ranking import BROADCAST_ROWS, small_side
from threadlens.session import bound_batches, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS pairs of least shingles: at a similarity of 0.8 a band is shared with probability 0.26, and
#: one of all bands with 0.999; a passage that makes up a third of two texts brings them together rarely.
BANDS, ROWS = 24, 3
TASK_MEMBERS = 1000
#: Large bands go through another round of centres if the last one has left this share of their members at most.
ROUND_LEAVES = 0.9
_RNG = np.random.default_rng(20240607)
_SALT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text, labelled with their occurrence number."""
    n = max(1, len(words) - SHINGLE + 1)
    x, mixed = np.zeros(n, dtype=np.uint64), _mix(words)
    for i in range(min(SHINGLE, len(words))):
        x += mixed[i:i + n] * _PLACE[i]
    ranked = np.sort(x)
    if (ranked[1:] == ranked[:-1]).any():
        order = np.argsort(x, kind="stable")
        ranked = x[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        at = np.arange(n)
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        x = x + occurrence * _PLACE[SHINGLE]
    return _mix(x)


def _bands(words: np.ndarray) -> np.ndarray:
    x = _shingles(words)
    # A row per hash function, as least values are found fastest along rows.
    h = (x ^ _SALT[:, None]) * _FACTOR[:, None]
    scratch = h >> np.uint64(31)
    h ^= scratch
    h *= np.uint64(0x9E3779B97F4A7C15)
    np.right_shift(h, np.uint64(29), out=scratch)
    h ^= scratch
    functions = np.arange(len(h))
    first = h.argmin(axis=1)
    a = h[functions, first]
    h[functions, first] = _MOST
    second = h.argmin(axis=1)
    b = np.where(len(x) > 1, h[functions, second], _MOST)
    ordered = np.where(first <= second, a * _PLACE[0] + b, b * _PLACE[0] + a)
    rows = _mix(ordered).reshape(BANDS, ROWS)
    band = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        band = _mix(band * _PLACE[1] + rows[:, i])
    return band.view(np.int64)


def _coded(texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
    """The words of each text as numbers, equal for equal words, and the hash of each number's word."""
    number: dict[str, int] = {}
    codes = [[number.setdefault(word, len(number)) for word in text.split()] for text in texts]
    words = np.array(list(number), dtype=object)
    return codes, pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def _band_lists(texts: pa.Array) -> pa.Array:
    codes, hashes = _coded(texts.to_pylist())
    out = [_bands(hashes[np.array(c, dtype=np.int64)]) for c in codes]
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * BANDS, pa.int32()), pa.array(flat))


def matched_runs(a: list, b: list, band: int) -> list[int] | None:
    """Lengths of the runs of words that a shortest edit script keeps; None beyond ``band`` edits.

    Furthest points on the diagonals -d to d are extended for d = 0, 1, ... insertions and deletions, on those
    diagonals only from which the end is in reach of the edits that are left.
    """
    n, m = len(a), len(b)
    most, last = min(band, n + m), n - m
    zero = most + 1  # place of diagonal 0
    best, trace = [0] * (2 * zero + 1), []
    for d in range(most + 1):
        trace.append(best[zero - d - 1:zero + d + 2])
        low, high = max(-d, last - most + d), min(d, last + most - d)
        for k in range(low + ((low - d) & 1), high + 1, 2):
            left, right = best[zero + k - 1], best[zero + k + 1]
            x = right if k == -d or (k != d and left < right) else left + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            best[zero + k] = x
            if x >= n and y >= m:
                break
        else:
            continue
        break
    else:
        return None
    runs, x, y = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        v, k = trace[d], x - y
        left, right = v[k + d], v[k + d + 2]
        down = k == -d or (k != d and left < right)
        start = right if down else left + 1
        if d == 0:
            start = 0
        runs.append(x - start)
        x = start if down else start - 1
        y = x - (k + 1 if down else k - 1)
    return runs


class Text:
    """Words and counted shingles of one text."""

    def __init__(self, text: str):
        self.words = text.split()
        self.size = max(1, len(self.words) - SHINGLE + 1)
        self._shingles: Counter | None = None

    @property
    def shingles(self) -> Counter:
        if self._shingles is None:
            self._shingles = Counter(zip(*(self.words[i:] for i in range(SHINGLE))))
        return self._shingles


def similarity(a: Text, b: Text, threshold: float = THRESHOLD) -> float:
    """Share of shingles that the aligned runs of two texts have in common; 0 if surely below ``threshold``."""
    x, y = a.words, b.words
    if x == y:
        return 1.0
    if min(a.size, b.size) < threshold * max(a.size, b.size) or min(len(x), len(y)) < SHINGLE:
        return 0.0
    common = sum(min(n, b.shingles[g]) for g, n in a.shingles.items() if g in b.shingles)  # no alignment matches more
    if common < threshold * (a.size + b.size - common):
        return 0.0
    return _aligned(x, y, threshold)


def _aligned(x: list, y: list, threshold: float = THRESHOLD) -> float:
    """The similarity of two word lists with no regard to counts of shingles."""
    sizes = max(1, len(x) - SHINGLE + 1) + max(1, len(y) - SHINGLE + 1)
    least = threshold * sizes / (1 + threshold)
    runs = matched_runs(x, y, int(len(x) + len(y) - 2 * least))
    if runs is None:
        return 0.0
    kept = sum(max(0, r - SHINGLE + 1) for r in runs)
    return kept / (sizes - kept)


def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(Text(x), Text(y)) >= THRESHOLD for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as ``n`` says."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _prefixes(kind: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the rarest shingles of each text, by shingle and text, from the shingles' numbers: the texts, the start of each
    one's list, the entries text by text, and where those of a text begin.

    A text of n shingles has all but ``THRESHOLD`` n of them, and one, in its prefix: two texts that reach the threshold
    share one there, as both take shingles in the same order.
    """
    owner, count = np.repeat(np.arange(len(sizes)), sizes), np.bincount(kind)
    order = np.lexsort((kind, count[kind], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[(rank < (sizes - np.ceil(THRESHOLD * sizes - 1e-9))[owner] + 1) & (count[kind[order]] > 1)]
    kind, owner = kind[order], owner[order]
    by_kind = np.lexsort((owner, kind))
    kind, owner = kind[by_kind], owner[by_kind]
    new = np.append(True, kind[1:] != kind[:-1])[:len(kind)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
    of_text = np.argsort(owner, kind="stable")
    return owner, start, of_text, np.searchsorted(owner[of_text], np.arange(len(sizes) + 1))


def _settle(rows: list[tuple[int, int, int, str]], find, join) -> list[tuple[int, int]]:
    """Links (a, b) between the labels of (own, want, label, text), enough to connect all that belong together.

    Each row is compared with those before it whose ``own`` has a bit of its ``want``, but not within a component.
    """
    own, want = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    labels = [r[2] for r in rows]
    codes, hashes = _coded([r[3] for r in rows])
    shingles = [_shingles(hashes[np.array(c, dtype=np.int64)]) for c in codes]
    size = np.array([len(x) for x in shingles])
    first = np.cumsum(size) - size
    kind = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    owner, start, of_text, begin = _prefixes(kind, size)
    component = np.unique(np.array([find(x) for x in labels]), return_inverse=True)[1]
    here, found = np.zeros(kind.max() + 1, dtype=np.int64), []
    for i in range(1, len(rows)):
        entries = of_text[begin[i]:begin[i + 1]]
        near = np.unique(owner[_ranges(start[entries], entries - start[entries])])  # of a list, the texts before this one
        near = near[((own[near] & want[i]) != 0) & (component[near] != component[i])]
        if not len(near):
            continue
        mine = kind[first[i]:first[i] + size[i]]
        here[mine] = 1
        n = size[near]
        common = np.add.reduceat(here[kind[_ranges(first[near], n)]], np.cumsum(n) - n)  # no alignment matches more
        here[mine] = 0
        some = common >= THRESHOLD * (n + size[i] - common) - 1e-9
        near = near[some][np.argsort(-common[some], kind="stable")]
        while len(near):
            j, near = int(near[0]), near[1:]
            if codes[i] != codes[j] and (
                    min(len(codes[i]), len(codes[j])) < SHINGLE or _aligned(codes[i], codes[j]) < THRESHOLD):
                continue
            join(labels[i], labels[j])
            found.append((labels[i], labels[j]))
            component[component == component[j]] = component[i]
            near = near[component[near] != component[i]]
    return found


def _links_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (three columns of a cell, own, want, label, text), sorted, to links (a, b) between labels; the last cell first known at the end."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(a: int, b: int) -> None:
        parent[find(a)] = find(b)

    def made(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    cell, held = None, []
    for batch in batches:
        found = []
        for *key, own, want, label, raw in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if key != cell:
                found += _settle(held, find, join) if len(held) > 1 else []
                cell, held = key, []
            held.append((own, want, label, raw))
        yield made(found)
    yield made(_settle(held, find, join) if len(held) > 1 else [])


def _stars(members: DataFrame) -> DataFrame:
    """(band, node, centre) for the nodes of every band that two or more share, except the centres.

    The few bands that hold a large share of all rows are joined by broadcast, the others by shuffle.
    """
    groups = members.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    groups = materialize(groups, "bands")
    large = F.col("size") * HEAVY_GROUPS > members.count()
    heavy, light = F.broadcast(groups.filter(large)), groups.filter(~large)
    cols = ["band", "node", "centre"]
    inside = members.join(heavy, "band").select(cols)
    rest = members.join(heavy, "band", "left_anti").join(light, "band").select(cols)
    return inside.unionAll(rest).filter("node <> centre")


def band_members(texts: DataFrame) -> DataFrame:
    """(node, place, band) of ``texts`` (node, text)."""
    bound_batches(texts.sparkSession)
    bands = F.arrow_udf(_band_lists, T.ArrayType(T.LongType()))
    placed = texts.select("node", F.posexplode(bands("text")).alias("place", "band"))
    return materialize(placed.select("node", F.col("place").cast("byte").alias("place"), "band"), "members")


def _shared(members: DataFrame) -> DataFrame:
    """The rows of ``members`` whose band two or more nodes share, with the least node of the band as ``centre`` and its ``size``.

    If there are too many such bands to broadcast, members of others are left out by a Bloom filter and the rest is joined by shuffle,
    bands of a large share of all rows by broadcast.
    """
    sizes = members.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    sizes = materialize(sizes, "bands")
    cols = ["node", "place", "band", "centre", "size"]
    if sizes.count() <= BROADCAST_ROWS:
        return materialize(members.join(F.broadcast(sizes), "band").select(cols), "members")
    large = F.col("size") * HEAVY_GROUPS > members.count()
    heavy, light = F.broadcast(sizes.filter(large)), sizes.filter(~large)
    bands = sizes.select("band")
    members = mark_possible_repeats(members, "band", "maybe", keys=bands.unionAll(bands)).filter("maybe")
    rest = members.join(heavy, "band", "left_anti").join(light, "band").select(cols)
    return materialize(members.join(heavy, "band").select(cols).unionAll(rest), "members")


def candidates(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose node is in ``members``, and few others, found by a Bloom filter: texts are not shuffled."""
    nodes = materialize(members.select("node").distinct(), "candidate-nodes")
    marked = mark_possible_repeats(texts, "node", "maybe", keys=nodes.unionAll(nodes))
    return materialize(marked.filter("maybe").select("node", "text"), "candidates")


def _in_cells(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that ``_links_in_cells`` finds among ``rows`` (three columns of a cell, own, want, label, node)."""
    cell = rows.columns[:3]
    full = rows.join(texts, "node").select(*cell, "own", "want", "label", "text")
    full = full.repartition(*cell).sortWithinPartitions(*cell, "want", "label")
    return full.mapInArrow(_links_in_cells, "a bigint, b bigint")


def _small_bands(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever belongs together among ``members``, bands of few nodes.

    The bands of one centre are one cell, with a bit for each, unless they have too many nodes: then each is one. The centre
    has one band at each place, so the place tells them apart.
    """
    bits = F.expr("bit_or(shiftleft(1L, CAST(place AS int)))")
    cells = materialize(members.groupBy("centre", "node").agg(bits.alias("bits")), "cells")
    crowded = cells.groupBy("centre").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * TASK_MEMBERS).select("centre", F.lit(True).alias("crowded"))
    cells = cells.join(small_side(crowded, "crowded"), "centre", "left")
    each = F.when(F.col("crowded"), F.expr(f"filter(transform(sequence(0, {BANDS - 1}), i -> shiftleft(1L, i)), b -> (b & bits) <> 0)"))
    cells = cells.withColumn("one", F.explode(F.coalesce(each, F.array(F.lit(0).cast("long")))))
    bits = F.when(F.col("one") == 0, F.col("bits")).otherwise(F.col("one"))
    cells = cells.select("centre", "one", F.lit(0).alias("all"), bits.alias("own"), bits.alias("want"), F.col("node").alias("label"), "node")
    return _in_cells(cells, texts)


def links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): verified links between nodes of ``texts`` (node, text) that share a band of ``members``.

    They connect all that belong together in bands of up to ``TASK_MEMBERS`` nodes; larger ones are only linked with centres.
    """
    found = _small_bands(texts, members.filter(F.col("size") <= TASK_MEMBERS))
    large = members.filter(F.col("size") > TASK_MEMBERS).select("node", "band")
    linked = F.arrow_udf(_linked, T.BooleanType())
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    n = large.count()
    while n and _largest(large) > TASK_MEMBERS:
        stars = materialize(_stars(large), "stars")
        pairs = stars.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        judged = pairs.join(left, "a").join(right, "b").select("a", "b", linked("left", "right").alias("ok"))
        judged = materialize(judged, "judged")
        found = found.unionAll(judged.filter("ok").select("a", "b"))
        failed = judged.filter("NOT ok").select(F.col("a").alias("node"), F.col("b").alias("centre"))
        large = materialize(stars.join(failed, ["node", "centre"], "left_semi").select("node", "band"), "members")
        before, n = n, large.count()
        if n > ROUND_LEAVES * before:
            break
    return materialize(found, "links")


def _across(texts: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): links between labels whose nodes share a band, enough to join all that belong together.

    ``members`` are those of large bands. The nodes of a band are cut into blocks of about ``TASK_MEMBERS``, the largest component apart from
    the others. Every pair of blocks meets in one cell, but for those within the largest component.
    """
    known = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    known = materialize(known, "known")
    kinds = known.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    blocks = lambda n: F.ceil(n / TASK_MEMBERS).cast("int")
    kinds = kinds.filter("most < size").select(
        "band", "size", "main", blocks(F.col("most")).alias("own"), blocks(F.col("size") - F.col("most")).alias("other"))
    kinds = materialize(kinds, "mixed")
    large = F.col("size") * HEAVY_GROUPS > known.count()
    heavy, light = F.broadcast(kinds.filter(large)), kinds.filter(~large)
    cols = ["band", "node", "label", "main", "own", "other"]
    mixed = known.join(heavy, "band").select(cols).unionAll(
        known.join(heavy, "band", "left_anti").join(light, "band").select(cols))
    place = F.xxhash64("node")
    block = F.when(F.col("label") == F.col("main"), F.pmod(place, "own")).otherwise(F.col("own") + F.pmod(place, "other"))
    mixed = mixed.withColumn("g", block.cast("int")).withColumn("all", F.expr("sequence(0, own + other - 1)"))
    cells = F.expr("""concat(
        transform(filter(all, x -> g >= own AND x <= g), x -> struct(x AS lo, g AS hi, false AS late)),
        transform(filter(all, x -> x >= own AND x > g), x -> struct(g AS lo, x AS hi, true AS late)))""")
    rows = mixed.select("band", "node", "label", F.explode(cells).alias("c")).select("band", "c.*", "node", "label")
    # Within a block all meet, of two blocks the rows of one meet those of the other.
    one = F.lit(1).cast("long")
    rows = rows.select(
        "band", "lo", "hi", F.when(F.col("late"), 0).otherwise(one).alias("own"),
        F.when((F.col("lo") < F.col("hi")) & ~F.col("late"), 0).otherwise(one).alias("want"), "label", "node")
    return materialize(_in_cells(rows, texts), "across")


def connected(texts: DataFrame) -> DataFrame:
    """(node, label): nodes of ``texts`` (node, text) with the same label are one class; nodes of their own may be absent."""
    # A node without a shared band takes part in no comparison, so its text is not moved.
    members = _shared(band_members(texts))
    some = candidates(texts, members)
    labels = components(links(some, members))
    large = members.filter(F.col("size") > TASK_MEMBERS).select("band", "node")
    if large.isEmpty():
        return labels
    more = _across(some, large, labels)
    if more.isEmpty():
        return labels
    further = components(more).select(F.col("node").alias("label"), F.col("label").alias("last"))
    further = small_side(further, "further")
    full = labels.unionAll(further.select(F.col("label").alias("node"), "label")).distinct()
    return materialize(full.join(further, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")


def _largest(members: DataFrame) -> int:
    return members.groupBy("band").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge: the least node that it is connected to.

    Each round takes the least label among the neighbours and then that label's own label; it is a written table, and
    rounds go on until no label changes. Labels are broadcast if there are few.
    """
    both = materialize(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("label")), "labels")
    side = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda table: table
    while True:
        near = both.join(side(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        spread = near.join(side(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = spread.join(side(jump), "label").select("node", "old", F.least("label", "further").alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels


def node_of(text_col: str):
    return F.xxhash64(F.sha2(collapse_spaces(F.col(text_col)), 256))


def _first_texts(rows: DataFrame) -> DataFrame:
    """(node, text): one text of each node of ``rows`` (id, node, text). As in ``drop_exact_copies`` only texts that may stay are shuffled."""
    marked = mark_possible_repeats(rows, "node", "maybe", keys=rows.select("node"))
    alone, maybe = marked.filter("NOT maybe").select("node", "text"), marked.filter("maybe")
    pair = F.concat_ws(" ", F.col("node").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("pair")
    winners = maybe.groupBy("node").agg(F.min("id").alias("id")).select(pair)
    first = maybe.select("node", "text", pair).join(winners, "pair", "left_semi").dropDuplicates(["pair"])
    return alone.unionAll(materialize(first.select("node", "text"), "first-texts"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, class_id, class_size, kept), a row for every row of ``df``; the least id of a class stays."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Texts are digested once; all that follows reads the nodes.
    rows = materialize(rows.select("id", node_of("text").alias("node"), "text"), "texts")
    ids = rows.select("id", "node")
    labels = connected(_first_texts(rows))
    nodes = ids.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.join(labels, "node", "left").select("node", "least", "n", F.coalesce("label", "node").alias("label"))
    nodes = materialize(nodes, "nodes")
    classes = nodes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = materialize(nodes.join(classes, "label").select("node", "n", "class_id", "class_size"), "classes")
    large = F.col("n") * HEAVY_GROUPS > ids.count()
    heavy, light = F.broadcast(named.filter(large)), named.filter(~large)
    cols = ["id", "node", "class_id", "class_size"]
    out = ids.join(heavy, "node").select(cols).unionAll(ids.join(heavy, "node", "left_anti").join(light, "node").select(cols))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))).withColumnRenamed("id", id_col)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each class, all columns kept: the one with the least id.

    Only rows whose id may be one that goes, found by a Bloom filter, are digested and looked up; the others pass where they are.
    """
    gone = near_classes(df, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("id"), "node").distinct()
    gone = materialize(gone, "gone")
    ids = gone.select(F.xxhash64("id").alias("h"))
    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    marked = mark_possible_repeats(keyed, "h", "maybe", keys=ids.unionAll(ids))
    maybe = marked.filter("maybe").select("row", "id", node_of("text").alias("node"))
    match = maybe["id"].eqNullSafe(gone["id"]) & (maybe["node"] == gone["node"])
    return marked.filter("NOT maybe").select("row.*").unionAll(maybe.join(gone, match, "left_anti").select("row.*"))
