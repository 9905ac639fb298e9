"""Removal of byte strings that repeat anywhere in the corpus, by longest-previous-factor arrays.

A byte goes if a window of ``window`` bytes that covers it also starts at another place. Equal windows
have the same minimiser, the least hash of the ``GRAM``-byte strings inside, at the same offset, so
windows only need to meet by minimiser (anchor). The consecutive windows of an anchor form its span.
Anchors that occur once settle as unique. Spans that occur twice settle as repeated. Only where one anchor
has different spans (the edges of repeated passages) are the bytes of the spans compared: they are
gathered by anchor, a suffix array is built over them, and the previous and next smaller positions in
suffix order give each window's longest earlier match. A window is repeated if that match is long enough,
or if it is the earlier place of such a match. Anchors with very many different spans are settled by
grouping hashes of blocks of windows instead, from coarse to fine, which any number of tasks can share.

Anchors are compared by 64-bit hashes. Edge cases: null counts as empty, and texts shorter than a window
keep all bytes. Matches never cross texts. Rows that repeat are repeats of each other and lose all bytes
inside windows. Removal may cut a character in two, so what is kept is binary. Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.exact_dedup import HEAVY_GROUPS
from threadlens.operators.ranking import small_side
from threadlens.session import materialize

WINDOW, GRAM = 200, 32
#: Windows per pass over a long text, bytes per suffix array, and spans per anchor that share one.
PASS_WINDOWS, ARRAY_BYTES, ARRAY_SPANS = 1 << 20, 1 << 18, 500
#: Windows per block where spans are too many for an array; the last ones are single windows.
BLOCKS = (64, 16, 4, 1)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n, base, dtype=np.uint64))])


_LONGEST = PASS_WINDOWS + WINDOW
_UP, _DOWN = _powers(_BASE, _LONGEST), _powers(_INVERSE, _LONGEST)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of any substrings of up to ``_LONGEST`` bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([[_U(0)], np.cumsum(_VALUES[data] * _UP[:len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """(anchor hash, span hash, first window, last window) of one text, as arrays."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    width = window - GRAM + 1  # grams per window
    for lo in range(0, max(0, len(data) - window + 1), PASS_WINDOWS):
        part = data[lo:lo + PASS_WINDOWS + window - 1]
        n = len(part) - window + 1
        hashes = Hashes(part)
        at = np.arange(n + width - 1)
        gram = hashes.of(at, at + GRAM)
        packed = (gram & _U(0xFFFFFFFFFF000000)) | at.astype(np.uint64)  # the place decides ties
        blocks = np.full(-(-len(packed) // width) * width, _U(0xFFFFFFFFFFFFFFFF))
        blocks[:len(packed)] = packed
        blocks = blocks.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(right[:n], left[width - 1:width - 1 + n]) & _U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        span = _mix(hashes.of(first, last + window) + (anchor[first] - first).astype(np.uint64))
        for p, x in zip(parts, (gram[anchor[first]].view(np.int64), span.view(np.int64), first + lo, last + lo)):
            p.append(x)
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


ANCHOR = T.ArrayType(T.StructType([
    T.StructField("h", T.LongType()), T.StructField("span", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
]))


def _anchor_lists(texts: pa.Array) -> pa.Array:
    made = [anchors(_bytes(t)) for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(m[0]) for m in made)])
    kinds = (np.int64, np.int64, np.int32, np.int32)
    cols = [pa.array(np.concatenate([np.zeros(0, k), *(m[i].astype(k) for m in made)])) for i, k in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=["h", "span", "first", "last"]))


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``data`` by its first ``length`` symbols or more, and the matches of neighbours.

    Prefix doubling; ``lcp[i]`` is the common prefix of suffixes i - 1 and i, up to what was compared.
    """
    n, step = len(data), 1
    levels = [np.unique(data, return_inverse=True)[1].astype(np.int64) + 1]
    while step < length:
        rank = levels[-1]
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - step)] = rank[step:]
        levels.append(np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ok = (i < n) & (j < n)
        same = np.zeros(len(i), dtype=bool)
        same[ok] = levels[level][i[ok]] == levels[level][j[ok]]
        # Ranks of suffixes that end early only agree for one and the same suffix.
        i, j = i + same * (1 << level), j + same * (1 << level)
        lcp[1:] += same * (1 << level)
    return order, lcp


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position, the length of the longest match that starts earlier, and where it starts (-1: none).

    The best earlier match of a suffix is its previous or next one with a smaller position in suffix order.
    """
    n = len(order)
    length, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    pos, match = order.tolist(), lcp.tolist()
    best, where = [0] * n, [-1] * n
    for ranks in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # (position, match with the suffix below it on the stack)
        forward = ranks.step == 1
        for r in ranks:
            p = pos[r]
            m = match[r] if forward else (match[r + 1] if r + 1 < n else 0)
            while stack and stack[-1][0] > p:
                m = min(m, stack.pop()[1])
            if stack and m > best[p]:
                best[p], where[p] = m, stack[-1][0]
            stack.append((p, m if stack else 0))
    length[:], source[:] = best, where
    return length, source


def repeated_windows(spans: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each string, the starts of windows that also start elsewhere in the strings."""
    size = np.array([len(s) for s in spans])
    begin = np.cumsum(size + 1) - size - 1
    data = np.zeros(int((size + 1).sum()), dtype=np.int64)
    for i, (b, s) in enumerate(zip(begin, spans)):
        data[b:b + len(s)] = np.frombuffer(s, dtype=np.uint8)
        data[b + len(s)] = 256 + i  # a separator of its own: no match runs over it
    order, lcp = suffix_order(data, window)
    # Only suffixes beside one that they match over a window can have a factor that long; runs of them are kept, places renumbered.
    match = np.append(lcp, 0) >= window
    near = match[:-1] | match[1:]
    place = np.sort(order[near])
    length, source = longest_previous_factors(np.searchsorted(place, order[near]), lcp[near])
    hit = np.zeros(len(data), dtype=bool)
    later = np.flatnonzero(length >= window)
    hit[place[later]] = True
    hit[place[source[later]]] = True
    return [np.flatnonzero(hit[b:b + n]) for b, n in zip(begin, size)]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, key, first, n, data), sorted by h, to (key, starts) of the spans with n = 1."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        found = repeated_windows([x[4] for x in held])
        rows = [(x[1], (f + x[2]).tolist()) for x, f in zip(held, found) if x[3] == 1 and len(f)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["key", "starts"])

    total = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "first", "n", "data"))):
            if total >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield flush()
                total = 0
            held.append(row)
            total += len(row[4])
    if held:
        yield flush()


def _cut(text: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text.to_pylist(), first.to_pylist(), last.to_pylist()):
        data = (t or "").encode()
        out.append([data[x:y + WINDOW] for x, y in zip(a, b)])
    return pa.array(out, pa.list_(pa.binary()))


BLOCK = T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("core", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("data", T.BinaryType()),
]))


def _anchor_places(data: pa.Array) -> pa.Array:
    """Place of each span's first window among the windows that can hold its anchor, counted from the one that ends with it."""
    out, width = [], WINDOW - GRAM + 1
    for s in data.to_pylist():
        at = np.arange(width)
        gram = Hashes(np.frombuffer(s, dtype=np.uint8)[:WINDOW]).of(at, at + GRAM)
        out.append(width - 1 - int(((gram & _U(0xFFFFFFFFFF000000)) | at.astype(np.uint64)).argmin()))
    return pa.array(out, pa.int32())


def _blocks(data: pa.Array, at: pa.Array, width: pa.Array) -> pa.Array:
    """The windows of each string in blocks of ``width`` places: hash of the bytes that all windows of such a block hold
    (``core``), hash of all bytes of those present (``whole``), and these bytes."""
    ends, parts, pieces = [0], [[], [], []], []
    for s, p, w in zip(data.to_pylist(), at.to_pylist(), width.to_pylist()):
        last = p + len(s) - WINDOW
        block = np.arange(p // w, last // w + 1) * w
        lo, hi = np.maximum(block, p), np.minimum(block + w - 1, last)
        hashes = Hashes(np.frombuffer(s, dtype=np.uint8))
        core = _mix(hashes.of(block + w - 1 - p, block + WINDOW - p) + block.astype(np.uint64))
        whole = _mix(hashes.of(lo - p, hi + WINDOW - p) + lo.astype(np.uint64))
        for x, y in zip(parts, (lo.astype(np.int32), core.view(np.int64), whole.view(np.int64))):
            x.append(y)
        pieces += [s[x:y] for x, y in zip((lo - p).tolist(), (hi + WINDOW - p).tolist())]
        ends.append(ends[-1] + len(block))
    kinds = (np.int32, np.int64, np.int64)
    cols = [pa.array(np.concatenate([np.zeros(0, k), *x])) for k, x in zip(kinds, parts)]
    made = pa.StructArray.from_arrays([*cols, pa.array(pieces, pa.binary())], names=["at", "core", "whole", "data"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def _settle_by_blocks(spans: DataFrame) -> DataFrame:
    """(key, first, last): repeated windows of the spans (key, first, n, data) with n = 1.

    Equal windows have the same place before their anchor, so blocks of windows meet by place and content. A block whose bytes
    occur twice is repeated as a whole, and one whose core occurs once has no repeated window. Only the others are cut further, one
    of equal ones for all: a span that differs from others at an edge keeps the block with the edge, not a row a window.
    """
    place, cut = F.arrow_udf(_anchor_places, T.IntegerType()), F.arrow_udf(_blocks, BLOCK)
    rows = spans.select("key", "first", "n", place("data").alias("at"), "data")
    found = None
    for width in BLOCKS:
        made = rows.select("key", "first", "n", F.col("at").alias("was"), F.explode(cut("data", "at", F.lit(width))).alias("b"))
        start = (F.col("first") + F.col("b.at") - F.col("was")).alias("first")
        blocks = materialize(made.select("key", start, "n", "b.at", "b.core", "b.whole", "b.data"), "blocks")
        one = [F.any_value(c).alias(c) for c in ("key", "first", "n", "at", "data")]
        kinds = blocks.groupBy("core", "whole").agg(F.count("*").alias("m"), *one)
        kinds = materialize(kinds, "block-kinds")
        twice = small_side(kinds.filter("m > 1").select("whole"), "repeated-blocks")
        last = (F.col("first") + F.octet_length("data") - WINDOW).cast("int").alias("last")
        good = blocks.filter("n = 1").join(twice, "whole", "left_semi").select("key", F.col("first").cast("int").alias("first"), last)
        found = good if found is None else found.unionAll(good)
        mixed = small_side(kinds.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"), "mixed-cores")
        n = F.when(F.col("m") > 1, 2).otherwise(F.col("n")).cast("long").alias("n")
        rows = kinds.join(mixed, "core", "left_semi").select("key", "first", n, "at", "data")
    return found


def _remove(text: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """Struct of what is kept, and the maximal removed runs."""
    out = []
    for t, a, b in zip(text.to_pylist(), start.to_pylist(), end.to_pylist()):
        data = (t or "").encode()
        if not a:
            out.append({"kept": data, "starts": [], "ends": []})
            continue
        delta = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(delta, np.array(a), 1)
        np.add.at(delta, np.array(b), -1)
        gone = np.cumsum(delta) > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
        kept = np.frombuffer(data, dtype=np.uint8)[~gone[:-1]].tobytes()
        out.append({"kept": kept, "starts": change[::2].tolist(), "ends": change[1::2].tolist()})
    return pa.array(out, pa.struct([("kept", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))


REMOVED = T.StructType([
    T.StructField("kept", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def _repeated_anchors(occurrences: DataFrame) -> DataFrame:
    """Occurrences of anchors that occur twice, with ``mixed``: the anchor has different spans."""
    stats = occurrences.groupBy("h").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter("n > 1")
    stats = materialize(stats.select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    large = F.col("n") * HEAVY_GROUPS > occurrences.count()
    heavy, light = F.broadcast(stats.filter(large)), stats.filter(~large)
    cols = ["key", "h", "span", "first", "last", "mixed"]
    inside = occurrences.join(heavy, "h").select(cols)
    rest = occurrences.join(heavy, "h", "left_anti").join(light, "h").select(cols)
    return materialize(inside.unionAll(rest), "repeated")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept binary, starts, ends) per row of ``df``: the text without repeated windows."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    made = rows.filter(F.octet_length("text") >= WINDOW).select("key", F.explode(F.arrow_udf(_anchor_lists, ANCHOR)("text")).alias("a"))
    occurrences = materialize(made.select("key", "a.h", "a.span", "a.first", "a.last"), "occurrences")
    repeated = _repeated_anchors(occurrences)
    one = F.min(F.struct("key", "first", "last"))
    spans = materialize(repeated.filter("mixed").groupBy("h", "span").agg(F.count("*").alias("n"), one.alias("one")).select("h", "span", "n", "one.*"), "spans")
    # Spans that occur twice are repeated as a whole. What occurs once among different spans is compared.
    lone = spans.filter("n = 1").select("key", "first")
    mixed = repeated.filter("mixed").join(lone, ["key", "first"], "left_anti")
    whole = repeated.filter("NOT mixed").select("key", "first", "last").unionAll(mixed.select("key", "first", "last"))
    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("h", "span", "n", "first", "last")).alias("s"))
    cut = F.arrow_udf(_cut, T.ArrayType(T.BinaryType()))
    parts = rows.select("key", "text").join(by_key, "key").select("key", "s", cut("text", F.col("s.first"), F.col("s.last")).alias("d"))
    parts = parts.select("key", F.explode(F.arrays_zip("s", "d")).alias("x")).select("key", "x.s.h", "x.s.span", "x.s.n", "x.s.first", F.col("x.d").alias("data"))
    parts = materialize(parts, "parts")
    many = materialize(parts.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > ARRAY_SPANS).select("h"), "many")
    small = parts.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    found = small.select("h", "key", "first", "n", "data").mapInArrow(_settle, "key bigint, starts array<bigint>")
    found = found.select("key", F.explode("starts").alias("first"))
    single = found.select("key", F.col("first").cast("int").alias("first"), F.col("first").cast("int").alias("last"))
    if not many.isEmpty():
        single = single.unionAll(_settle_by_blocks(parts.join(many, "h", "left_semi").select("key", "first", "n", "data")))
    gone = whole.unionAll(single).groupBy("key").agg(F.collect_list(F.struct("first", (F.col("last") + WINDOW).alias("end"))).alias("g"))
    empty = F.array().cast("array<int>")
    result = rows.join(gone, "key", "left").select("id", "text", F.coalesce("g.first", empty).alias("a"), F.coalesce("g.end", empty).alias("b"))
    result = result.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.arrow_udf(_remove, REMOVED)("text", "a", "b").alias("r"))
    return result.select(F.col("id").alias(id_col), "n_bytes", "r.kept", "r.starts", "r.ends")
