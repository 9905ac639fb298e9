"""Stupid-backoff language-model scores as joins with n-gram count tables.

S(w | v) = n(v w) / n(v) if the pair was counted, else ALPHA n(w) / N; the first word of a text has no
context and gets n(w) / N. Words are compared by 64-bit hashes. ``count_tables`` makes the tables,
``score`` joins any texts with them, backing off where a pair is missing.

``score_corpus`` scores every text of a corpus under the counts of all other rows: from n(v w), n(v), n(w)
and N the row's own occurrences are taken away, so a pair that no other row has backs off and a text cannot
vouch for itself. A copy in another row does count. Each distinct pair of a text is one row with its count,
exploded and shuffled once to the pair's hash, where it meets its total; what is known there (ln of the
pair count, or the two words of a missing pair) is joined with the word counts and summed per text.

Frequent keys never meet in one task: the most frequent pairs and words (at most HEAVY of each)
are counted with map-side aggregation and joined by broadcast. Which pairs those are is guessed from
a hash sample of texts; the guess decides the route and never the result. Texts with more than 1 / HOT
of all rows as copies are collapsed to one weighted row first, so the sample sees repeated texts as they weigh.

Edge cases: null counts as empty; a text without words has a null score. A word that no other row has
counts as seen once. Rows that repeat are scored alike. Words end at ASCII white space. A corpus of one
row has N = 1, and each of its words scores as seen once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import materialize

ALPHA = 0.4
#: Bound on the pairs and on the words that are broadcast.
HEAVY = 200_000
#: Bound on the texts that are collapsed because of their copies.
HOT = 10_000
#: One text in so many is looked at to guess frequent pairs.
SAMPLE = 8
#: Words that a task holds as arrays at a time.
SLICE_WORDS = 200_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("key"), word_hashes(F.col("text")).alias("w"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(key, v, w, h): neighbouring words and the hash of the pair."""
    n = F.size("w")
    both = F.arrays_zip(F.slice("w", 1, n - 1).alias("v"), F.slice("w", 2, n - 1).alias("w"))
    some = rows.filter(n > 1).select("key", F.explode(both).alias("p"))
    return some.select("key", F.col("p.v").alias("v"), F.col("p.w").alias("w"), F.xxhash64("p.v", "p.w").alias("h"))


def count_tables(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pair and word counts, each a written table (h, n)."""
    rows = _prepared(df.withColumn("__id", F.lit(0)), "__id", text_col)
    pairs = _pairs(rows).groupBy("h").agg(F.count("*").alias("n"))
    words = rows.select(F.explode("w").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return materialize(pairs, "pairs"), materialize(words, "words")


def score(df: DataFrame, pairs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score) of texts under given tables, with backoff."""
    total = F.lit(float(words.agg(F.sum("n")).first()[0] or 1))
    rows = _prepared(df, id_col, text_col)
    uni = words.withColumnRenamed("n", "c")
    seen = _pairs(rows).join(pairs, "h", "left")
    hit = seen.filter("n IS NOT NULL").join(uni.withColumnRenamed("h", "v"), "v", "left")
    hit = hit.select("key", F.ln(F.col("n") / F.greatest(F.coalesce("c", F.lit(1)), F.col("n"))).alias("s"))
    first = rows.filter(F.size("w") > 0).select("key", F.col("w")[0].alias("h"), F.lit(1.0).alias("f"))
    miss = seen.filter("n IS NULL").select("key", F.col("w").alias("h"), F.lit(ALPHA).alias("f")).unionAll(first)
    miss = miss.join(uni, "h", "left").select("key", F.ln(F.col("f") * F.coalesce("c", F.lit(1)) / total).alias("s"))
    sums = hit.unionAll(miss).groupBy("key").agg(F.avg("s").alias("mean"))
    return _named(rows, sums, id_col)


def _named(rows: DataFrame, means: DataFrame, id_col: str) -> DataFrame:
    about = rows.select("id", "key", F.size("w").cast("long").alias("n_words"))
    out = about.join(means, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_words", (F.col("mean") * F.col("n_words")).alias("log_score"))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts rows by ``keys``, the first place of each run of equal rows, and the run lengths."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number and hash of every word of a batch, how often its row has the word, and where texts end."""
    lists = batch.column("w")
    lengths = np.diff(lists.offsets.to_numpy())
    doc, word = np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy()
    order, _, length = _runs(doc, word)
    own = np.empty(len(word), dtype="int64")
    own[order] = np.repeat(length, length)
    last = np.ones(len(word), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    return doc, word, own, last


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts, in slices of some SLICE_WORDS words (or one text)."""
    for batch in batches:
        ends = batch.column("w").offsets.to_numpy()
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_WORDS, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        doc, word, own, last = _flat(batch)
        # Words: the first one is scored by itself; all but the last are contexts.
        order, first, _ = _runs(doc, word)
        opens = np.ones(len(word), dtype=bool)
        opens[1:] = last[:-1]
        change = (opens.astype("int64") + last - 1)[order]
        coef = np.add.reduceat(change, first) if len(first) else change
        at = order[first]
        # Pairs: each distinct one of a text with its count.
        left = np.flatnonzero(~last)
        order, first, c = _runs(doc[left], word[left], word[left + 1])
        left = left[order[first]]
        both, is_word = np.concatenate([at, left]), np.arange(len(at) + len(left)) < len(at)
        after = np.where(is_word, 0, both + 1)
        columns = {
            "key": batch.column("key").to_numpy()[doc[both]], "weight": batch.column("weight").to_numpy()[doc[both]],
            "v": word[both], "w": pa.array(word[after] if len(word) else word, pa.int64(), mask=is_word),
            "c": np.concatenate([coef, c]), "own_v": own[both], "own_w": own[after] if len(word) else own,
        }
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns))


def _text_counts(rows: DataFrame) -> DataFrame:
    """Distinct pairs (v, w) of each text with their count ``c`` and the counts of both words in the text, and its
    distinct words (v, null), where ``c`` is how often ln n(v) enters the score as start (+) or context (-)."""
    schema = "key long, weight long, v long, w long, c long, own_v long, own_w long"
    return rows.select("key", "weight", "w").mapInArrow(_batches, schema)


def _weighted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, weight, w) of all texts; those with very many copies are one row of that weight."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(text).alias("key"), text.alias("text"))
    copies = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "copies")
    hot = F.broadcast(_above_share(copies, HOT).withColumnRenamed("n", "weight"))
    once = rows.join(hot, "key").groupBy("key", "weight").agg(F.max("text").alias("text"))
    rest = rows.join(hot, "key", "left_anti").select("key", F.lit(1).cast("long").alias("weight"), "text")
    return rest.unionAll(once.select("key", "weight", "text")).select("key", "weight", word_hashes(F.col("text")).alias("w"))


def _most_frequent(counts: DataFrame, bound: int) -> DataFrame:
    """The rows from some frequency on, the lowest that leaves at most ``bound`` rows.

    Frequencies are compared by eighths of their binary logarithm, so the driver sees at most 512 numbers.
    """
    step = F.floor(F.log2("n") * 8)
    bins = counts.filter("n > 1").groupBy(step.alias("b")).agg(F.count("*").alias("m")).orderBy(F.desc("b")).collect()
    within, cut = 0, None
    for row in bins:
        within += row["m"]
        if within > bound:
            break
        cut = row["b"]
    return counts.filter((F.col("n") > 1) & (step >= cut)) if cut is not None else counts.limit(0)


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score) of every text under the counts of all other rows."""
    rows = _weighted(df, id_col, text_col)
    counts = _text_counts(rows)
    size = F.when(F.col("w").isNull(), F.col("own_v")).otherwise(F.col("c")) * F.col("weight")
    sampled = _text_counts(rows.filter(F.pmod("key", F.lit(SAMPLE)) == 0)).filter("w IS NOT NULL")
    guess = materialize(sampled.groupBy("v", "w").agg(F.sum(size).alias("n")), "sample")
    marked = F.broadcast(materialize(_most_frequent(guess, HEAVY).select("v", "w", F.lit(True).alias("often")), "marked"))
    routed = counts.join(marked, ["v", "w"], "left")
    kept = routed.filter("w IS NULL OR often").groupBy("v", "w").agg(F.sum(size).alias("n"))
    tables = materialize(kept, "counts")
    words = tables.filter("w IS NULL").select(F.col("v").alias("word"), "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    # Words and frequent pairs stay in their task; the other pairs are shuffled once and meet their count in a
    # window, which saves the second shuffle of a join with grouped counts.
    near = routed.filter("w IS NULL OR often").drop("often")
    near = near.join(F.broadcast(tables.filter("w IS NOT NULL")), ["v", "w"], "left")
    far = routed.filter("w IS NOT NULL AND often IS NULL").drop("often")
    far = far.withColumn("n", F.sum(size).over(Window.partitionBy("v", "w")))
    cols = ["key", "v", "w", "c", "own_v", "own_w", "n"]
    seen = near.select(*cols).unionAll(far.select(*cols)).withColumn("n", F.col("n") - F.col("c"))
    # A missing pair gives back the context's ln n(v), which all contexts are charged, and pays for its own word.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    part = lambda word, own, miss: F.struct(
        word.alias("word"), own.alias("own"), F.col("c").alias("coef"), F.lit(0.0).alias("s"), miss.alias("miss"))
    hit = F.struct(none.alias("word"), none.alias("own"), none.alias("coef"),
                   (F.col("c") * F.ln(F.col("n"))).alias("s"), zero.alias("miss"))
    word = part(F.col("v"), F.col("own_v"), zero)
    found = F.when(F.col("w").isNull(), F.array(word)).when(F.col("n") > 0, F.array(hit)).otherwise(
        F.array(word, part(F.col("w"), F.col("own_w"), F.col("c"))))
    parts = seen.select("key", F.explode(found).alias("p")).select("key", "p.*")
    heavy = F.broadcast(materialize(_most_frequent(words, HEAVY), "heavy"))
    paid = F.coalesce(F.col("coef") * F.ln(F.greatest(F.col("n") - F.col("own"), F.lit(1))), F.lit(0.0))
    # What is not paid yet is one row per text and word; it is joined with the word counts after that.
    open_word = F.when(F.col("n").isNull(), F.col("word"))
    parts = parts.join(heavy, "word", "left").groupBy("key", open_word.alias("word")).agg(
        F.sum(F.col("s") + paid).alias("s"), F.sum("miss").alias("miss"), F.max("own").alias("own"), F.sum("coef").alias("coef"))
    parts = materialize(parts, "parts")
    rest = parts.filter("word IS NOT NULL").join(words, "word").select("key", (F.col("s") + paid).alias("s"), "miss")
    sums = parts.filter("word IS NULL").select("key", "s", "miss").unionAll(rest)
    got = sums.groupBy("key").agg(F.sum("s").alias("s"), F.sum("miss").alias("miss"))
    about = rows.groupBy("key").agg(F.count("*").alias("r"), F.max(F.size("w").cast("long")).alias("n_words"))
    got = about.join(got, "key", "left")
    miss, others = F.col("miss") / F.col("r"), F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    log_score = F.col("s") / F.col("r") + miss * F.ln(F.lit(ALPHA)) - (miss + 1) * F.ln(others)
    got = got.select("key", "n_words", F.when(F.col("n_words") > 0, log_score).alias("log_score"))
    ids = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return ids.join(got, "key", "left").select(F.col("id").alias(id_col), "n_words", "log_score")


def _above_share(counts: DataFrame, parts: int) -> DataFrame:
    """Rows with more than 1 / ``parts`` of the total: fewer than ``parts`` of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * parts > total)
