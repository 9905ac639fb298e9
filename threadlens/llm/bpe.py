"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Encoding: a text is cut into matches of the tokenizer's pattern, and each distinct match is encoded once;
``MAX_MATCHES`` of them are kept for later texts, and beyond that those that came up in several slices. It is a row with the lists of its tokens and of the ranks of their pairs. In every
step of a recursive query each match contracts its leftmost pair of minimum rank, and the two new pairs
join the merge table, until no pair of any match is in the table. Decoding takes the bytes of the ids from the
vocabulary and joins them. Both work on a few megabytes of texts at a time, and nothing is shuffled. The recursive query holds the lists of
all its steps, some n^2 / 2 tokens for a match of n bytes, so a query takes matches up to ``SLICE_STEPS`` such tokens, the shortest first.

Cutting is done in two steps: a space before a character that is not white space always begins a match,
so texts are first split there, and the pattern runs once per distinct piece.

Edge cases: null counts as empty, and an empty text has no ids. Matches above ``LONG_BYTES`` bytes are
merged with a heap, which picks the same pairs and takes n log n steps. Ids outside the vocabulary raise.
All columns are handed through, except that a column with the output's name is replaced. Texts are
Unicode, so decoding the ids of a text gives its UTF-8 bytes back exactly.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import bound_batches

#: Tokens in the lists of all steps per recursive query, tokens decoded together, bytes of texts encoded together, and matches kept.
SLICE_STEPS = 4_000_000
SLICE_TOKENS = 1_000_000
CUT_BYTES = 8_000_000
MAX_MATCHES = 300_000
LONG_BYTES = 512
#: A space before white space of any kind, or at the end.
ODD_SPACE = r" (?:[\s\v\x{85}\x{1c}-\x{1f}\p{Z}]|$)"

#: ``k`` is the place of the pair that is contracted, from 1. List bounds below 0 count from the end, hence the first CASE.
ENCODE = """
WITH RECURSIVE t AS (
    SELECT w, ids, ranks FROM start_rows
    UNION ALL
    SELECT w, next_ids, list_concat(CASE WHEN k > 2 THEN ranks[1:k - 2] ELSE [] END, CASE WHEN k > 1 THEN [a.r] ELSE [] END,
                                    CASE WHEN k < len(ranks) THEN [b.r] ELSE [] END, ranks[k + 2:])
    FROM (
        SELECT w, ranks, k, list_concat(ids[1:k - 1], [best], ids[k + 2:]) AS next_ids,
               ids[k - 1]::BIGINT * 65536 + best AS before, best::BIGINT * 65536 + ids[k + 2] AS after
        FROM (SELECT w, ids, ranks, list_min(ranks) AS best, list_position(ranks, list_min(ranks)) AS k FROM t)
        WHERE best IS NOT NULL)
    LEFT JOIN merges a ON a.ab = before LEFT JOIN merges b ON b.ab = after)
SELECT ids FROM t WHERE list_min(ranks) IS NULL ORDER BY w
"""


def _spread(starts: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all members of the given runs, one run after the other, and the size of each run."""
    n = sizes[items]
    return np.arange(n.sum()) + np.repeat(starts[items] - (np.cumsum(n) - n), n), n


class Tables:
    """Rank table and vocabulary of one tokenizer, and DuckDB with its merge table."""

    def __init__(self, blob: bytes, pattern: str):
        lines = (line.split() for line in blob.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ids must be below 65536")
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile(r" (?=\S)")
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = dict(zip(zip(left, right), rank))
        self.bytes_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        first, second = np.divmod(np.arange(1 << 16), 256)
        both = zip(self.bytes_id[first].tolist(), self.bytes_id[second].tolist())
        self.bytes_rank = np.fromiter((self.pairs.get(p, -1) for p in both), dtype=np.int32, count=1 << 16)
        self.known = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.known[list(self.ranks.values())] = True
        pieces = [b""] * len(self.known)
        for token, r in self.ranks.items():
            pieces[r] = token
        self.pieces = pa.array(pieces, pa.binary())
        self.place: dict[bytes, int] = {}
        self.pool, self.start, self.size, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "400MB"})
        ab = np.array(left, dtype=np.int64) * 65536 + np.array(right, dtype=np.int64)
        self._load("merges", pa.table({"ab": ab, "r": pa.array(rank, pa.int32())}))

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _run(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _merge_long(self, piece: bytes) -> list[int]:
        """Leftmost minimum-rank merging of one long match with a heap over linked tokens."""
        ids = self.bytes_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (ids[a], ids[b]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[ids[a], ids[b]], a))
        return [x for x in ids if x >= 0]

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and their number per piece. Pieces come in order of their length."""
        ids, sizes = [], []
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        steps = np.concatenate([[0], np.cumsum(size * (size + 1) // 2)])
        at = 0
        while at < len(pieces):
            to = max(at + 1, int(np.searchsorted(steps, steps[at] + SLICE_STEPS, side="right")) - 1)
            part, n = pieces[at:to], size[at:to]
            flat = np.frombuffer(b"".join(part), dtype=np.uint8)
            ends = np.concatenate([[0], np.cumsum(n)])
            inside = np.ones(len(flat), dtype=bool)  # the last byte of a match begins no pair
            inside[ends[1:] - 1] = False
            rank = self.bytes_rank[(flat[:-1].astype(np.int64) * 256 + flat[1:])[inside[:-1]]]
            rows = pa.table({
                "w": np.arange(len(part)), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.bytes_id[flat]),
                "ranks": pa.ListArray.from_arrays(pa.array(ends - np.arange(len(ends)), pa.int32()), pa.array(rank, mask=rank < 0))})
            for got in self._run("start_rows", rows, ENCODE)["ids"].chunks:
                ids.append(got.flatten().to_numpy())
                sizes.append(np.asarray(pc.list_value_length(got)).astype(np.int64))
            at = to
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode_matches(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, sizes): the ids of match i are ``pool[starts[i]:starts[i] + sizes[i]]``."""
        rank = np.fromiter((self.ranks.get(m, -1) for m in matches), dtype=np.int32, count=len(matches))
        size = np.ones(len(matches), dtype=np.int64)
        whole, split = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        long = [i for i in split.tolist() if len(matches[i]) > LONG_BYTES]
        short = np.setdiff1d(split, long)
        short = short[np.argsort([len(matches[i]) for i in short.tolist()], kind="stable")]
        ids, size[short] = self._merge_short([matches[i] for i in short.tolist()])
        merged = [np.array(self._merge_long(matches[i]), dtype=np.int32) for i in long]
        size[long] = [len(m) for m in merged]
        order = np.concatenate([whole, short, np.array(long, dtype=np.int64)])
        starts = np.empty(len(matches), dtype=np.int64)
        starts[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([rank[whole], ids, *merged]), starts, size

    def _known(self, matches: list[bytes]) -> np.ndarray:
        """Places of the matches among those kept; new ones are encoded first."""
        if len(self.place) > MAX_MATCHES:
            self._forget()
        new = [m for m in matches if m not in self.place]
        if new:
            pool, starts, size = self.encode_matches(new)
            self.place.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.start = np.concatenate([self.start, starts + len(self.pool)])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, pool])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        place = np.fromiter(map(self.place.__getitem__, matches), dtype=np.int64, count=len(matches))
        self.uses[place] += 1  # the matches of a slice are distinct
        return place

    def _forget(self) -> None:
        """Keep the matches that at least two slices had, half of ``MAX_MATCHES`` at most; their uses count half from here."""
        least = max(2, int(np.sort(self.uses)[-(MAX_MATCHES // 2):][0]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        at, _ = _spread(self.start, self.size, kept)
        names = list(self.place)  # in order of their places
        self.place = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.pool, self.size, self.uses = self.pool[at], self.size[kept], self.uses[kept] // 2
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of ids per text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        total = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))])
        out, lo = [pa.array([], pa.list_(pa.int32()))], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CUT_BYTES, side="right")) - 1)
            out.append(self._encode(texts.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(out)

    def _encode(self, texts: pa.Array) -> pa.Array:
        odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE))
        # Where only a few texts have odd spaces, the others do not leave Arrow.
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        cut = [self.cut.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes = np.empty(len(texts), dtype=np.int64)
        sizes[~odd], sizes[odd] = np.asarray(pc.list_value_length(plain)), [len(c) for c in cut]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        strings = pa.concat_arrays([
            pc.cast(plain.flatten(), pa.large_string()), pa.array([p for c in cut for p in c], pa.large_string())])
        flat = pc.dictionary_encode(strings)
        names, codes = flat.dictionary, np.empty(len(strings), dtype=np.int64)
        codes[np.argsort(np.repeat(odd, sizes), kind="stable")] = np.asarray(flat.indices)
        codes[offsets[:-1]] += len(names)  # the first piece of a text has no space before it
        used = np.flatnonzero(np.bincount(codes, minlength=2 * len(names)))
        new = np.empty(2 * len(names), dtype=np.int64)
        new[used] = np.arange(len(used))
        after = names.take(pa.array(used[used < len(names)])).to_pylist()
        first = names.take(pa.array(used[used >= len(names)] - len(names))).to_pylist()
        found, counts = [], []
        for space, part in ((" ", after), ("", first)):
            for piece in part:
                # Letters after at most one space are a single match of any byte-level pattern in use.
                matches = [space + piece] if piece.isalpha() else self.pattern.findall(space + piece)
                found += matches
                counts.append(len(matches))
        words = pc.dictionary_encode(pa.array(found, pa.large_string()))
        place = self._known(words.dictionary.cast(pa.large_binary()).to_pylist())
        counts = np.array(counts, dtype=np.int64)
        word_at, words_in = _spread(np.cumsum(counts) - counts, counts, new[codes])
        word = place[np.asarray(words.indices)][word_at]
        at, ids_in = _spread(self.start, self.size, word)
        ends = np.concatenate([[0], np.cumsum(ids_in)])[np.concatenate([[0], np.cumsum(words_in)])[offsets]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.pool[at], pa.int32()))

    def decode(self, lists: pa.Array) -> pa.Array:
        """UTF-8 bytes per list of ids: the bytes of the ids, taken from the vocabulary and joined, some ``SLICE_TOKENS`` at a time."""
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        ids = np.asarray(lists.flatten())
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("id outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(size)])
        out, lo = [pa.array([], pa.binary())], 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS, side="right")) - 1)
            taken = self.pieces.take(pa.array(ids[ends[lo]:ends[hi]]))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[lo:hi + 1] - ends[lo], pa.int32()), taken), b""))
            lo = hi
        return pa.concat_arrays(out)


@lru_cache(maxsize=2)
def _tables(blob: bytes, pattern: str) -> Tables:
    return Tables(blob, pattern)


def _shared(df: DataFrame, ranks_path: str):
    """The rank file, read on the driver and broadcast: executors need not have it. Batches are cut by bytes from here."""
    bound_batches(df.sparkSession)
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out`` (array<int>): the ids of the whole text, without special tokens."""
    shared = _shared(df, ranks_path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return _tables(shared.value, pattern).encode(texts)

    return df.withColumn(out, ids(F.col(text_col)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the ids."""
    shared = _shared(df, ranks_path)

    @F.arrow_udf(T.BinaryType())
    def text(ids: pa.Array) -> pa.Array:
        return _tables(shared.value, pattern).decode(ids)

    return df.withColumn(out, text(F.col(ids_col)))
