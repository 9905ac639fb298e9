"""Hard negatives of anchor vectors, from exact integer scores by matrix products in a residue number system.

Vectors are integers. Their matrices are reduced modulo several small primes, multiplied in float32 (a product
of reduced components summed over ``chunk`` of them stays below 2^24, so every sum is exact in any order), and signed
scores are put together again by the Chinese remainder theorem in mixed radix with centred digits. The number of primes follows
from the largest norm in the table, so that no score can wrap around.

Rows are dealt out into blocks of bounded size, anchors into every block: anchors travel, rows do not. A block streams the anchors past
its rows batch by batch. The first pass returns each block's best rows of the anchor's label, and a window over these few keeps
the anchor's positives. The second pass knows the positives' scores, returns each block's best rows of other labels whose score
lies between ``low`` and ``high`` hundredths of a positive's score, and a window over these ranks them.

Definitions: a component x counts as floor(scale * x), x as double. The score is the inner product; of vectors of different length,
the shorter one is filled up with zeros. Higher scores come first, ties by smaller id. An anchor never is its own
positive or negative; neither is another row with its id. Equal anchor rows count as one anchor.

Edge cases: rows take no part whose id, label or vector is null, whose vector has a null or non-finite component, or whose squared norm
exceeds 2^62 (scores of others fit a bigint by the Cauchy-Schwarz inequality). Repeated rows that are no anchors stand for themselves.
An anchor without positives, and a positive without negatives in range, have no rows. No input rows give no rows. Columns other than the
three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import materialize

#: Components held by a block, and scores computed at once.
BLOCK_COMPONENTS = 1 << 22
CELL_SCORES = 1 << 21
#: Moduli are primes below 2^8: centred residues are at most 125, 1,073 products of them sum up below 2^24.
LARGEST_MODULUS = 256

ROWS = "block bigint, anchor bigint, id bigint, label bigint, vector array<double>, positives array<struct<rank:int,id:bigint,score:bigint>>"
FOUND = "anchor bigint, positive_rank int, positive_id bigint, positive_score bigint, id bigint, score bigint"
FOUND_ARROW = pa.schema([
    ("anchor", pa.int64()), ("positive_rank", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("id", pa.int64()), ("score", pa.int64())])


def moduli(bound: float) -> list[int]:
    """Enough primes, from the largest down, for their product to tell scores between -bound and bound apart."""
    primes = [p for p in range(LARGEST_MODULUS - 1, 2, -2) if all(p % d for d in range(3, int(p ** 0.5) + 1, 2))]
    out, product = [], 1
    while product <= 2 * bound + 1:
        out.append(primes[len(out)])
        product *= out[-1]
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residue of integers below 2^23 between -(p - 1) / 2 and (p - 1) / 2, in the type of ``x``."""
    return x - p * np.rint(x / x.dtype.type(p))


def residues(vectors: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of integral doubles of any size, as float32."""
    r = np.fmod(vectors, p)
    return centred(r, p).astype(np.float32)


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed scores of all rows of ``a`` with all rows of ``b``, given their residues per prime."""
    digits, out, radix = [], 0, 1
    for k, p in enumerate(primes):
        chunk = (1 << 24) // ((p - 1) // 2) ** 2
        digit = np.zeros((len(a[k]), len(b[k])))
        for at in range(0, a[k].shape[1], chunk):
            digit = centred(digit + a[k][:, at:at + chunk] @ b[k][:, at:at + chunk].T, p)
        digit = digit.astype(np.float32)
        for earlier, q in zip(digits, primes):
            digit = centred((digit - earlier) * np.float32(pow(q, -1, p)), p)
        digits.append(digit)
        # int64 wraps around in the middle of very large scores and comes back, as the score itself fits.
        out = out + digit.astype(np.int64) * np.int64(radix - (radix >> 63 << 64))
        radix = (radix * p) % (1 << 64)
    return out


def first(scores: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` of the given rows with the highest scores, ties by position."""
    if len(rows) > n:
        mine = scores[rows]
        least = np.partition(mine, len(mine) - n)[len(mine) - n]
        above, equal = rows[mine > least], rows[mine == least]
        rows = np.concatenate([above, equal[:n - len(above)]])
    return rows[np.lexsort((rows, -scores[rows]))]


class Block:
    """Rows of one block in order of their ids, with their residues."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], vectors: list[np.ndarray], primes: list[int]):
        self.ids, self.labels = np.concatenate(ids), np.concatenate(labels)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels = self.ids[order], self.labels[order]
        vectors = np.concatenate(vectors)[order]
        self.residues, self.primes = [residues(vectors, p) for p in primes], primes

    def scores(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the anchor, scores of all rows) per anchor."""
        step = max(1, CELL_SCORES // len(self.ids))
        for at in range(0, len(vectors), step):
            part = vectors[at:at + step]
            cell = product([residues(part, p) for p in self.primes], self.residues, self.primes)
            yield from zip(range(at, at + len(part)), cell)

    def positives(self, anchor: int, label: int, scores: np.ndarray, n: int) -> Iterator[tuple]:
        rows = first(scores, np.flatnonzero((self.labels == label) & (self.ids != anchor)), n)
        yield from ((None, None, None, int(self.ids[r]), int(scores[r])) for r in rows)

    def negatives(self, anchor: int, label: int, scores: np.ndarray, n: int, positives: list, low: int, high: int) -> Iterator[tuple]:
        others = np.flatnonzero((self.labels != label) & (self.ids != anchor))
        mine = scores[others]
        for p in positives:
            least, most = -(-low * p["score"] // 100), high * p["score"] // 100
            if least <= most:
                rows = first(scores, others[(mine >= least) & (mine <= most)], n)
                yield from ((p["rank"], p["id"], p["score"], int(self.ids[r]), int(scores[r])) for r in rows)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros."""
    size = np.asarray(vectors.value_lengths()).astype(np.int64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = np.asarray(vectors.flatten())
    return out


def _cells(primes: list[int], width: int, n: int, window: tuple[int, int] | None):
    """Task: rows of a block come first, then the anchors, which are scored batch by batch against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], None
        for batch in batches:
            blocks = np.asarray(batch["block"])
            is_row = np.asarray(batch["anchor"].is_null())
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                part = batch.slice(lo, hi - lo)
                if part.num_rows == 0:
                    continue
                if blocks[lo] != at:
                    at, rows, block = blocks[lo], [], None
                vectors = _matrix(part["vector"], width)
                ids, labels = np.asarray(part["id"]), np.asarray(part["label"])
                if is_row[lo]:
                    rows.append((ids, labels, vectors))
                    continue
                if block is None and rows:
                    block, rows = Block(*map(list, zip(*rows)), primes), []
                if block is None:
                    continue
                out, anchors = [], part["anchor"].to_pylist()
                positives = part["positives"].to_pylist()
                for i, scores in block.scores(vectors):
                    found = (
                        block.positives(ids[i], labels[i], scores, n) if window is None
                        else block.negatives(ids[i], labels[i], scores, n, positives[i], *window))
                    out += [(anchors[i], *row) for row in found]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, f.type) for column, f in zip(zip(*out), FOUND_ARROW)], schema=FOUND_ARROW)

    return run


def usable(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vector of integral doubles, norm) of the rows that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    # Doubles from 2^53 on are integral, and floor() returns a bigint.
    floors = F.transform("scaled", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    plain = F.forall("scaled", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("scaled"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("scaled").isNotNull() & plain)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("id", "label", floors.alias("vector")).withColumn("norm", norm).filter(F.col("norm") <= float(1 << 62))


def mine(
    df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` per anchor and positive.

    ``anchors`` is a condition on the column ``id`` that picks the anchors; ``label`` the label as an expression on ``df``.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, label, vector_col, scale), "vectors")
    count, width, norm = rows.agg(F.count("*"), F.max(F.size("vector")), F.max("norm")).first()
    width, primes = max(width or 0, 1), moduli((norm or 0.0) * 1.000001)
    per_block = max(1, BLOCK_COMPONENTS // width)
    blocks = max(-(-count // per_block), spark.sparkContext.defaultParallelism)
    chosen = rows.filter(anchors).select("id", "label", "vector").distinct()
    chosen = materialize(chosen.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    none = F.lit(None)
    dealt = rows.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).alias("block"), none.cast("bigint").alias("anchor"), "id", "label", "vector",
        F.array().cast("array<struct<rank:int,id:bigint,score:bigint>>").alias("positives"))

    def best(asking: DataFrame, n: int, window: tuple[int, int] | None) -> DataFrame:
        everywhere = asking.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
            "anchor", "id", "label", "vector", "positives")
        cells = dealt.unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", F.asc_nulls_first("anchor"))
        found = cells.mapInArrow(_cells(primes, width, n, window), FOUND)
        w = Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    near = best(chosen.withColumn("positives", F.array().cast("array<struct<rank:int,id:bigint,score:bigint>>")), n_positives, None)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asking = materialize(chosen.join(near, "anchor"), "positives")
    hard = best(asking, n_negatives, (low, high))
    return hard.join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
