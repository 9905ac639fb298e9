"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizers encode the whole text (a space put in front). Byte offsets at which a token that begins with a space starts in
both sequences are anchors: tokens of both end there, which is verified on the byte lengths of the tokens, not assumed.
Anchors split a document into windows, each named by the tuples of its token ids. Within a slice of texts, different windows
are collected by that name and each is aligned once, whatever the number of its occurrences. Aligning cuts it at every
byte offset where tokens of both end. All token pairs within such a group are linked.

Counting documents per linked id pair is a map-side aggregated ``groupBy``. Scoring looks the pairs of a document up: the ``HOT_PAIRS``
most frequent ones in a broadcast table of that bounded size, all others by a shuffled join, and sums go back per document.
So the pairs of frequent words, which nearly every document holds, are never shuffled by document.

Tokenizing works on different pieces of a batch only: texts are cut before a space that follows a character other than white space,
where a byte-level match always begins, and where no piece of the other vocabulary reaches across (verified when it is loaded).

Edge cases: texts that are null or empty, or that the tokens of either side do not give back byte for byte, have no tokens, no
groups, no links, and an empty ``groups_sha256``; they count for no pair. Strings of special tokens are plain text. Repeated rows
count as documents of their own. Texts are processed whole; a very long one without spaces is one
window. Columns of the input are handed through unless they have the name of an output.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.token_counts import byte_alphabet
from threadlens.session import materialize

#: Pairs in the broadcast table, links of a group above which its ids are counted first, pieces encoded in one call, and
#: bytes of texts that are cut into pieces together and aligned together.
HOT_PAIRS = 1 << 18
MANY_LINKS = 10_000
PIECES = 10_000
CUT_BYTES = 15_000_000
ALIGN_BYTES = 1_000_000
SPACE_MARK = "▁"

FOUND = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
])


#: A space at the start of a text or after white space of any kind.
ODD_SPACE = r"(?:^|[\s\v\x{85}\x{1c}-\x{1f}\p{Z}]) "
NONE_FOUND = pa.array([], pa.struct([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))


class Coded:
    """Token ids of many strings, one after the other, with the start and number of each string's."""

    def __init__(self) -> None:
        self.parts, self.sizes = [], []

    def add(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.sizes.append(size)
        self.parts.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum())))

    def done(self) -> Coded:
        self.pool, self.size = np.concatenate([np.zeros(0, np.int32), *self.parts]), np.concatenate([np.zeros(0, np.int64), *self.sizes])
        self.start, self.parts = np.cumsum(self.size) - self.size, []
        return self

    def take(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given strings in order, and the number of ids of each."""
        return self.pool[runs(self.start[items], self.size[items])], self.size[items]


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions ``start[i]`` to ``start[i] + size[i] - 1``, run after run."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def tuples(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> pa.DictionaryArray:
    """Names of consecutive stretches of two id sequences: the ids of ``a``, -1, the ids of ``b``, as bytes.

    Stretch i covers ``a[a_at[i]:a_at[i + 1]]`` and ``b[b_at[i]:b_at[i + 1]]``.
    """
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    offsets = np.concatenate([[0], np.cumsum(n_a + n_b + 1)])
    both = np.full(offsets[-1], -1, dtype=np.int32)
    both[runs(offsets[:-1], n_a)] = a
    both[runs(offsets[:-1] + n_a + 1, n_b)] = b
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(n_a), [None, pa.py_buffer(offsets * 4), pa.py_buffer(both)]).dictionary_encode()


class Stretches:
    """The different id tuples behind such names: ``both`` holds ``n_a`` ids from ``a_from`` and ``n_b`` from ``b_from`` on."""

    def __init__(self, names: pa.DictionaryArray):
        self.code = np.asarray(names.indices).astype(np.int64)
        _, offsets, data = names.dictionary.buffers()
        self.both = np.frombuffer(data, dtype=np.int32)
        offsets = np.frombuffer(offsets, dtype=np.int64)[:len(names.dictionary) + 1] // 4
        self.a_from, border = offsets[:-1], np.flatnonzero(self.both[:offsets[-1]] == -1)
        self.b_from = border + 1
        self.n_a, self.n_b = border - self.a_from, offsets[1:] - self.b_from

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self.both[runs(self.a_from, self.n_a)], self.both[runs(self.b_from, self.n_b)]

    def texts(self) -> list[str]:
        """``a1,a2|b1`` per tuple."""
        said = self.both.astype(str).tolist() if len(self.both) else []
        return [
            f"{said[i]}|{said[j]}" if x == y == 1 else ",".join(said[i:i + x]) + "|" + ",".join(said[j:j + y])
            for i, x, j, y in zip(self.a_from.tolist(), self.n_a.tolist(), self.b_from.tolist(), self.n_b.tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, times, number of entries per tuple): every id of ``a`` with every id of ``b``."""
        size = self.n_a * self.n_b
        many = np.flatnonzero(size > MANY_LINKS)
        few = np.where(size > MANY_LINKS, 0, size)
        k = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
        wide = np.repeat(self.n_b, few)
        x = self.both[np.repeat(self.a_from, few) + k // wide].astype(np.int64)
        pairs, times = x << 20 | self.both[np.repeat(self.b_from, few) + k % wide], np.ones(len(k), dtype=np.int64)
        if not len(many):
            return pairs, times, few
        cut = np.concatenate([[0], np.cumsum(few)])
        parts, counts = np.split(pairs, cut[1:-1]), np.split(times, cut[1:-1])
        for g in many.tolist():
            x, n = np.unique(self.both[self.a_from[g]:self.a_from[g] + self.n_a[g]], return_counts=True)
            y, m = np.unique(self.both[self.b_from[g]:self.b_from[g] + self.n_b[g]], return_counts=True)
            parts[g], counts[g] = (x.astype(np.int64)[:, None] << 20 | y).ravel(), (n[:, None] * m).ravel()
        return np.concatenate(parts), np.concatenate(counts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


class Aligner:
    """The two tokenizers, the bytes of their tokens, and how to align their sequences."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        # One thread: a task has one core, and each thread would hold memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for name, i in json.loads(byte_level)["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in name)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names):
            raise ValueError("a piece with a space inside reaches across words")
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(SPACE_MARK, " ").encode()
            for i, name in enumerate(names)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 20:
            raise ValueError("ids must be below 2^20")
        self.blank = [self.b.piece_to_id(SPACE_MARK)]
        self.a_size, self.a_space = self._measure(self.a_bytes)
        self.b_size, self.b_space = self._measure(self.b_bytes)
        self.cut = re.compile(r"(?<=\S) ")

    @staticmethod
    def _measure(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        return size, np.fromiter((t.startswith(b" ") for t in tokens), dtype=bool, count=len(tokens))

    def _code(self, pieces: pa.Array) -> tuple[Coded, Coded, np.ndarray]:
        """Ids of a space and each piece on both sides, and whether both give its bytes back."""
        a, b, good = Coded(), Coded(), np.ones(len(pieces), dtype=bool)
        for at in range(0, len(pieces), PIECES):
            part = pieces.slice(at, PIECES).to_pylist()
            spaced = [" " + p for p in part]
            sides = (
                ([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)], a, self.a_bytes),
                ([x if p else self.blank for x, p in zip(self.b.encode(part, num_threads=1), part)], b, self.b_bytes))
            joined = "".join(spaced).encode()
            for ids, coded, names in sides:
                coded.add(ids)
                if b"".join(map(names.__getitem__, chain.from_iterable(ids))) != joined:
                    good[at:at + PIECES] &= [b"".join(map(names.__getitem__, x)) == w.encode() for x, w in zip(ids, spaced)]
        return a.done(), b.done(), good

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Windows of two token sequences over the same bytes, and the byte at which each begins."""
        a_start, b_start = np.cumsum(self.a_size[a]) - self.a_size[a], np.cumsum(self.b_size[b]) - self.b_size[b]
        anchors = np.intersect1d(a_start[self.a_space[a]], b_start[self.b_space[b]], assume_unique=True)
        a_at, b_at = np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors)
        return tuples(a, np.append(a_at, len(a)), b, np.append(b_at, len(b))), anchors

    def groups(self, windows: Stretches) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Groups of all different windows, one window after the other, and the number of groups of each."""
        a, b = windows.ids()
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        a_at, b_at = np.searchsorted(a_end, shared) + 1, np.searchsorted(b_end, shared) + 1
        last = np.searchsorted(a_at, np.cumsum(windows.n_a)) + 1
        return tuples(a, np.append(0, a_at), b, np.append(0, b_at)), np.diff(last, prepend=0)

    def _cut(self, texts: pa.Array, odd: bool) -> list[pa.StructArray]:
        """Cut texts into pieces, encode the different ones, and align slice by slice."""
        if odd:
            lists = pa.array([self.cut.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        pieces = lists.flatten().dictionary_encode()
        a_ids, b_ids, good = self._code(pieces.dictionary)
        code, size = np.asarray(pieces.indices).astype(np.int64), 1 + np.asarray(pc.binary_length(pieces.dictionary))
        return [
            self._slice(texts.slice(lo, hi - lo), code[ends[lo]:ends[hi]], np.diff(ends[lo:hi + 1]), size, a_ids, b_ids, good)
            for lo, hi in _stretches(texts, ALIGN_BYTES)]

    def _slice(
        self, texts: pa.Array, code: np.ndarray, per_text: np.ndarray, size: np.ndarray, a_ids: Coded, b_ids: Coded, good: np.ndarray,
    ) -> pa.StructArray:
        text_of = np.repeat(np.arange(len(texts)), per_text)
        text_bytes = np.bincount(text_of, size[code], minlength=len(texts)).astype(np.int64)
        right = np.asarray(pc.binary_length(texts)) > 0
        for i in np.unique(text_of[~good[code]]).tolist():
            mine, whole = code[text_of == i], (" " + texts[i].as_py()).encode()
            right[i] &= all(
                b"".join(names[x] for x in ids.take(mine)[0].tolist()) == whole
                for ids, names in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)))
        code, text_of = code[right[text_of]], text_of[right[text_of]]
        a, a_in = a_ids.take(code)
        b, b_in = b_ids.take(code)
        n = len(texts)
        n_a = np.bincount(text_of, a_in, minlength=n).astype(np.int64)
        n_b = np.bincount(text_of, b_in, minlength=n).astype(np.int64)
        if not len(a):
            none, zero = [[]] * n, np.zeros(n, np.int64)
            return self._struct(n_a, n_b, zero, zero, [""] * n, pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int32())))
        names, begin = self.windows(a, b)
        window = Stretches(names)
        names, per_window = self.groups(window)
        group = Stretches(names)
        begins = np.cumsum(text_bytes * right) - text_bytes * right
        doc = np.searchsorted(begins + text_bytes * right, begin, side="right")
        # From here on one entry per group of a document.
        doc = np.repeat(doc, per_window[window.code])
        code = group.code[runs((np.cumsum(per_window) - per_window)[window.code], per_window[window.code])]
        groups = np.bincount(doc, minlength=n)
        links = np.bincount(doc, (group.n_a * group.n_b)[code], minlength=n).astype(np.int64)
        said, at, listed = group.texts(), np.searchsorted(doc, np.arange(n + 1)).tolist(), code.tolist()
        digests = [
            hashlib.sha256(";".join([said[g] for g in listed[lo:hi]]).encode()).hexdigest() if hi > lo else ""
            for lo, hi in zip(at[:-1], at[1:])]
        once, often = np.unique(doc * len(said) + code, return_counts=True)
        doc, code = once // len(said), once % len(said)
        pairs, times, size = group.links()
        spread = runs((np.cumsum(size) - size)[code], size[code])
        kinds, kind = np.unique(pairs, return_inverse=True)
        held = np.repeat(doc, size[code]) * len(kinds) + kind[spread]
        held, back = np.unique(held, return_inverse=True)
        times = np.bincount(back, times[spread] * np.repeat(often, size[code])).astype(np.int32)
        offsets = pa.array(np.searchsorted(held // len(kinds), np.arange(n + 1)), pa.int32())
        pairs = pa.ListArray.from_arrays(offsets, pa.array(kinds[held % len(kinds)]))
        return self._struct(n_a, n_b, groups, links, digests, pairs, pa.ListArray.from_arrays(offsets, pa.array(times)))

    @staticmethod
    def _struct(*columns) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], FOUND.names)

    def align_texts(self, texts: pa.Array) -> pa.Array:
        """One row of ``FOUND`` per text.

        Texts with a space at the start or after white space are cut by a regular expression, all others at every space.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE))
        rows, order = [NONE_FOUND], []
        for kind in (False, True):
            mine = np.flatnonzero(odd == kind)
            some = texts.take(pa.array(mine))
            rows += chain.from_iterable(self._cut(some.slice(lo, hi - lo), kind) for lo, hi in _stretches(some, CUT_BYTES))
            order.append(mine)
        rows = pa.concat_arrays(rows)
        return rows.take(pa.array(np.argsort(np.concatenate(order)))) if odd.any() else rows


def _stretches(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Consecutive texts of about that many bytes together, at least one text each."""
    total = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))])
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + size, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


@lru_cache(maxsize=2)
def _aligner(byte_level: str, pieces: bytes) -> Aligner:
    return Aligner(byte_level, pieces)


def alignments(df: DataFrame, byte_level_path: str, pieces_path: str, text_col: str = "text", out: str = "found") -> DataFrame:
    """Add ``out``: numbers of tokens, groups and links, digest of the groups, and the linked id pairs with their times.

    A pair is packed as ``a_id * 2^20 + b_id``. The tokenizer files are read on the driver.
    """
    with open(byte_level_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:
        shared = df.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return _aligner(*shared.value).align_texts(texts)

    return df.withColumn(out, found(F.col(text_col)))


def pair_counts(found: DataFrame, pairs_col: str = "found.pairs") -> DataFrame:
    """Per linked pair: ``n_docs`` that hold it, and ``best``, whether no pair of its A id is in more."""
    counts = materialize(found.select(F.explode(pairs_col).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 20).alias("a_id")).agg(F.max("n_docs").alias("most"))
    joined = counts.join(most, F.shiftright("pair", 20) == F.col("a_id"))
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_alignment(df: DataFrame, byte_level_path: str, pieces_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` to every row.

    ``n_best`` counts the links whose pair is the most frequent of its A id, ``count_sum`` sums the document counts of all links.
    """
    row, found, key = _free("row", df), _free("found", df), _free("key", df)
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), F.col(text_col).alias("__text"))
    table = alignments(named, byte_level_path, pieces_path, "__text", found).drop("__text")
    table = materialize(table.withColumn(key, F.monotonically_increasing_id()), "alignment")
    counts = materialize(pair_counts(table, f"{found}.pairs"), "pair-counts")
    hot = F.broadcast(counts.orderBy(F.desc("n_docs"), "pair").limit(HOT_PAIRS))
    links = table.select(key, F.explode(F.arrays_zip(f"{found}.pairs", f"{found}.times")).alias("l")).select(
        key, F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    near = links.join(hot, "pair").groupBy(key).agg(*sums)
    far = links.join(hot, "pair", "left_anti").join(counts, "pair").groupBy(key).agg(*sums)
    scores = near.unionByName(far).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return table.select(
        key, row, *[F.col(f"{found}.{c}").alias(c) for c in made if c not in ("n_best", "count_sum")]
    ).join(scores, key, "left").select(
        *[F.col(f"{row}.`{c}`").alias(c) for c in df.columns if c not in made],
        *[F.coalesce(c, F.lit(0)).alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in made])


def _free(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column."""
    while name in df.columns:
        name = "_" + name
    return name
