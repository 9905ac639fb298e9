"""Sentence borders learned from the corpus, after Kiss and Strunk (2006), Unsupervised multilingual sentence boundary detection.

``abbreviation_types`` counts every word type with and without a final period and scores how much more
the period belongs to the type than chance would have it; short types and types with inner periods score higher, and
each occurrence without a period lowers the score. ``sentence_borders`` then splits after words that end
with .!? unless the word is an abbreviation with one period ("Dr. Smith" stays one sentence).

Words are counted as they are, map-side, and only different words are typed; the count table of types is written once. Only
candidate words (about one a sentence) are kept for the decision, joined with the abbreviations (by broadcast if their counted number allows) and brought back
as the set of border positions per different text, so copies are decided once per task.

Edge cases: null and blank texts have no sentence. Repeated rows, null ids and equal ids are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.ranking import small_side
from threadlens.session import materialize

#: Published constants: share of periods expected of an abbreviation, and the least score of one.
PERIOD_SHARE = 0.99
MIN_SCORE = 0.3

ONE_PERIOD = r"[^.!?]\.$"
WORD_TYPE = r"^[\p{L}.]*\p{L}$"
LEADING = r"^[^\p{L}\p{N}]+"


def word_type(word: Column) -> Column:
    """Lower-case word without opening marks and final period."""
    return F.regexp_replace(F.lower(F.regexp_replace(word, r"\.$", "")), LEADING, "")


def abbreviation_types(df: DataFrame, text_col: str, min_score: float = MIN_SCORE) -> DataFrame:
    """(word_type, n_with, n_without, score) of the types whose final period belongs to them."""
    found = df.select(F.explode(tx.words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    typed = found.select(word_type(F.col("w")).alias("word_type"), F.col("w").rlike(ONE_PERIOD).alias("p"), "c")
    typed = materialize(typed.filter(F.col("word_type").rlike(WORD_TYPE)).groupBy("word_type").agg(
        F.sum(F.when(F.col("p"), F.col("c")).otherwise(0)).alias("n_with"),
        F.sum(F.when(F.col("p"), 0).otherwise(F.col("c"))).alias("n_without")), "word-types")
    share = typed.agg((F.sum("n_with") / F.sum(F.col("n_with") + F.col("n_without"))).alias("s"))
    at = F.least(F.greatest(share.select("s").scalar(), F.lit(1e-9)), F.lit(1 - 1e-9))
    letters = F.length(F.replace("word_type", F.lit("."), F.lit("")))
    k, rest = F.col("n_with"), F.col("n_without")
    gain = 2 * (k * (F.ln(F.lit(PERIOD_SHARE)) - F.ln(at)) + rest * (F.ln(F.lit(1 - PERIOD_SHARE)) - F.ln(1 - at)))
    inner = F.length("word_type") - letters + 1
    score = gain * inner * F.exp(-letters - rest * F.ln(letters))
    return typed.withColumn("score", score).filter((k > 0) & (F.col("score") >= min_score))


def sentence_borders(df: DataFrame, text_col: str, abbreviations: DataFrame) -> DataFrame:
    """Columns of ``df`` and ``sentence_words`` (words per sentence) and ``n_abbreviations`` (periods that do not split)."""
    texts = df.select(F.sha2(F.col(text_col), 256).alias("k"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    texts = texts.select("k", tx.words(F.col("t")).alias("__w"))
    each = texts.select("k", F.size("__w").alias("n"), F.posexplode("__w").alias("at", "w"))
    marked = F.endswith("w", F.lit(".")) | F.endswith("w", F.lit("!")) | F.endswith("w", F.lit("?"))
    ends = each.filter(marked & (F.col("at") < F.col("n") - 1))
    ends = ends.select("k", "at", F.when(F.col("w").rlike(ONE_PERIOD), word_type(F.col("w"))).alias("word_type"))
    known = small_side(abbreviations.select("word_type", F.lit(True).alias("kept")), "abbreviations")
    judged = ends.join(known, "word_type", "left").groupBy("k").agg(
        F.array_sort(F.collect_set(F.when(F.col("kept").isNull(), F.col("at")))).alias("b"),
        F.size(F.collect_set(F.when(F.col("kept"), F.col("at")))).cast("long").alias("a"))
    out = df.select(F.struct("*").alias("row"), F.sha2(F.col(text_col), 256).alias("k"),
                    F.size(tx.words(F.coalesce(F.col(text_col), F.lit("")))).alias("n"))
    out = out.join(judged, "k", "left")
    b = F.coalesce(F.col("b"), F.array().cast("array<int>"))
    lengths = F.zip_with(F.array_append(b, F.col("n") - 1), F.array_prepend(b, F.lit(-1)), lambda e, s: (e - s).cast("long"))
    none = F.array().cast("array<bigint>")
    return out.select("row.*", F.when(F.col("n") > 0, lengths).otherwise(none).alias("sentence_words"),
                      F.coalesce("a", F.lit(0).cast("long")).alias("n_abbreviations"))
