"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts. For each sample, every word draws r and c from
Gamma(2, 1) and b from U(0, 1), by hashing, so that all documents share the draws. With weight w the word
gets t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)); the word with the least a is the
sample, identified by (word, t). Two documents agree in a sample with the probability of their
generalised Jaccard similarity, sum of min counts over sum of max counts. As a is continuous, equal minima
mean equal (word, t), so a fingerprint keeps a 32-bit hash of each least a.

All steps are built-in expressions. Words are exploded and counted inside the partition that holds the
document, so only texts are shuffled, once.

Edge cases: null counts as empty; an empty text holds one empty word, so empty texts are alike. Leading or
trailing white space adds the empty word. Rows that repeat an id follow each other in the order of their
texts; a null id comes first. A single document is its own next one. Other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import materialize

SAMPLES = 64
#: Samples that one row of the aggregation carries.
STEP = 8
#: Ids that share a bucket: what one task sorts together.
BUCKET_IDS = 256
WIDE_BUCKET = 4096


def _uniform(h: Column, shift: int, bits: int) -> Column:
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << bits))


def _draws(terms: DataFrame, keep: list[str], samples: int) -> DataFrame:
    """Rows per word and run of ``STEP`` samples ``k``, with the draws r, ln c and b of each sample in the run.

    Exploding the runs keeps the compiled code small; taking several samples at once makes a row's way
    through the aggregation serve all of them.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // STEP) - 1))).alias("k")
    hashes, draws = [], []
    for j in range(STEP):
        at = 2 * (F.col("k") * STEP + j)
        hashes += [F.xxhash64("term", at).alias(f"h{j}"), F.xxhash64("term", at + 1).alias(f"g{j}")]
        h, g = F.col(f"h{j}"), F.col(f"g{j}")
        draws += [
            (-F.ln(_uniform(h, 0, 21) * _uniform(h, 21, 21))).alias(f"r{j}"),
            F.ln(-F.ln(_uniform(h, 42, 21) * _uniform(g, 0, 30))).alias(f"log_c{j}"), _uniform(g, 30, 30).alias(f"b{j}"),
        ]
    return terms.select(*keep, "term", runs).select(*keep, "k", *hashes).select(*keep, "k", *draws)


def fingerprints(df: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, under the name of each text column, its fingerprint (array<int>).

    The texts of a row share the draws of their common words. Input partitioned by some of the keys is
    not shuffled. Keys must be unique.
    """
    each = [F.struct(F.lit(i).alias("v"), F.coalesce(F.col(t), F.lit("")).alias("t")) for i, t in enumerate(texts)]
    words = df.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.v", F.explode(F.split("x.t", r"\s+")).alias("word"))
    words = words.select(*keys, "v", F.xxhash64("word").alias("term"))
    counts = words.groupBy(*keys, "term").agg(*[F.count(F.when(F.col("v") == i, 1)).alias(f"n{i}") for i in range(len(texts))])
    logs = [f"w{i}" for i in range(len(texts))]
    weighed = counts.select(*keys, "term", *[F.when(F.col(f"n{i}") > 0, F.ln(f"n{i}")).alias(w) for i, w in enumerate(logs)])
    drawn = _draws(weighed, [*keys, *logs], samples)
    # ln a = ln c - r (t - b) - r; null where the text lacks the word
    least = [
        F.min(F.expr(f"log_c{j} - r{j} * (floor({w} / r{j} + b{j}) - b{j} + 1)")).alias(f"{w}_{j}")
        for w in logs for j in range(STEP)
    ]
    run = [F.array(*[F.hash(f"{w}_{j}") for j in range(STEP)]).alias(w) for w in logs]
    found = drawn.groupBy(*keys, "k").agg(*least).select(*keys, F.struct("k", *run).alias("s"))
    lists = found.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return lists.select(*keys, *[F.slice(F.flatten(f"s.{w}"), 1, samples).alias(t) for w, t in zip(logs, texts)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(samples))


def as_text(fingerprint: Column) -> Column:
    """Eight hex digits per sample."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def bucket_of(id_col: Column) -> Column:
    """A bucket number that does not decrease with the id."""
    return F.coalesce(F.floor(id_col / BUCKET_IDS), F.lit(-(1 << 60)))


def next_bucket(buckets: DataFrame) -> DataFrame:
    """(bucket, next): the bucket after each one, and the first after the last.

    Buckets are ordered within wide ranges; only one row per range is ordered in a single task.
    """
    wide = buckets.select("bucket", F.floor(F.col("bucket") / WIDE_BUCKET).alias("wide"))
    inner = wide.withColumn("next", F.lead("bucket").over(Window.partitionBy("wide").orderBy("bucket")))
    ranges = wide.groupBy("wide").agg(F.min("bucket").alias("first"))
    everywhere = Window.orderBy("wide")
    around = F.first("first").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select("wide", F.coalesce(F.lead("first").over(everywhere), around).alias("after"))
    return inner.join(ranges, "wide").select("bucket", F.coalesce("next", "after").alias("next"))


def with_next(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the next row over all buckets; the last row takes the first one's.

    ``rows`` are partitioned by ``bucket`` and come back so, with ``rn``, the place within the bucket.
    """
    in_bucket = Window.partitionBy("bucket").orderBy(*order)
    numbered = rows.withColumn("rn", F.row_number().over(in_bucket)).withColumn("__lead", F.lead(value).over(in_bucket))
    firsts = numbered.filter("rn = 1").select(F.col("bucket").alias("next"), F.struct(F.col(value).alias("v")).alias("__first"))
    links = next_bucket(rows.select("bucket").distinct()).join(firsts, "next").select("bucket", "__first")
    return numbered.join(links, "bucket").withColumn(out, F.coalesce("__lead", "__first.v")).drop("__lead", "__first")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many first ones of the next
    document in ascending order of ids. Columns: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", bucket_of(F.col("id")))
    both = with_next(rows, ["id", "text"], "text", "following")
    n = F.length("text")
    cut = F.expr("length(text) div 4")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("following"), F.lit(1), cut.cast("int")))
    both = both.select("bucket", "rn", "id", "text", edited.alias("edited"))
    about = both.select("bucket", "rn", "id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"))
    made = fingerprints(both, ["bucket", "rn"], ["text", "edited"], samples)
    made = made.select("bucket", "rn", F.col("text").alias("own"), "edited")
    table = materialize(about.join(made, ["bucket", "rn"]), "fingerprints").withColumnRenamed("rn", "at")
    final = with_next(table, ["at"], "own", "after")
    return final.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("after"), samples).alias("near_next"),
    )
