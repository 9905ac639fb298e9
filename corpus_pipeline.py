"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Language ID, exact deduplication, near deduplication, mixing, byte-level BPE. Stages hand through all
columns and rows that they keep; the last one adds the place in the mix and the token ids.

Edge cases: null and letterless texts go in the first stage; an empty table gives an empty result; repeated rows are exact copies.
Columns of the input with the name of one that the last stage adds (``ADDED``) are replaced by it, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import bpe, exact_dedup, langid, mixing, near_dedup
from threadlens.session import bound_batches, materialize


#: Columns that the last stage adds.
ADDED = ("lane", "mix_order", "token_ids", "n_tokens", "round_trip")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without any letter, or null, go.

    If no row has a language to learn from, every text with a letter stays. Workers outlive the stage, so its batches are cut as well.
    """
    bound_batches(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(langid.has_letter(docs))
    return docs.filter(langid.identify(docs, model)["lang"] != langid.UNKNOWN)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the mix of sources: reading the files in order yields the target weights."""
    return mixing.in_mix_order(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lane and place in the mix, token ids of each text, and whether decoding them gives the text back.

    Files do not keep an order once they are read as splits, so the place is worked out again, from the same
    rows with the same result, and kept as ``lane`` and ``mix_order``. Rows are written sorted by it.
    """
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED]
    mixed_docs = mixing.mix(docs).orderBy("mix_order").select(*kept, "lane", "mix_order")
    back = "decoded"
    while back in mixed_docs.columns:
        back = f"_{back}"
    both = bpe.decode(bpe.encode(mixed_docs, ranks, pattern), ranks, pattern, out=back)
    same = F.col(back) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("round_trip", same).drop(back)


STAGES = [
    ("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("tokens", tokens),
]
#: SQL cannot say language ID, near duplicates or BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, sorted into the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs.orderBy("mix_order")
