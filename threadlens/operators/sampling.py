"""Sampling, deduplication, splits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.scalars import hash_order
from threadlens.operators.project import is_clean
from threadlens.operators.ranking import (
    hash_cuts, hash_key, null_safe_join, quota_column, small_side, top_n_per_group,
)


def top_commented(
    df: DataFrame, group: str, score: str, targets: int | dict[str, int], id_col: str = "id"
) -> DataFrame:
    """The n highest-scored rows per community, ties going to the smaller id.

    Only (community, score, id) is ranked; the full rows are picked by community and id afterwards.
    """
    narrow = df.select(group, score, id_col)
    top = top_n_per_group(narrow, group, [F.desc(score), F.asc(id_col)], targets, id_col)
    chosen = small_side(top.select(group, id_col), "top-ids")
    return null_safe_join(df, chosen, [group, id_col], "left_semi").select(*df.columns)


def engagement_floor(
    sampled: DataFrame, group: str, score: str, targets: int | dict[str, int]
) -> DataFrame:
    """Per community: target, rows taken and the lowest score among them."""
    return sampled.groupBy(group).agg(
        F.count("*").alias("sample_size"), F.min(score).alias("min_score")
    ).withColumn("target", quota_column(group, targets).cast("long"))


def first_n_clean_per_group(
    df: DataFrame, group: str, text: str, ordinal: str, quota: int | dict[str, int],
    markers: list[str] | None = None,
) -> DataFrame:
    """The first n clean rows of each community in arrival order.

    The text is only read to decide what is clean; (community, ordinal) is ranked and the clean rows
    are picked by both afterwards, so ordinals may start anew in each community.
    """
    clean = df.filter(is_clean(text, markers) if markers is not None else is_clean(text))
    first = top_n_per_group(clean.select(group, ordinal), group, [F.asc(ordinal)], quota, ordinal)
    kept = small_side(first.select(group, ordinal), "first-ids")
    return null_safe_join(clean, kept, [group, ordinal], "left_semi").select(*df.columns)


def collection_rate(
    df: DataFrame, kept: DataFrame, group: str, ordinal: str, quota: int | dict[str, int]
) -> DataFrame:
    """Rows looked at until the quota was full, rows kept, and kept per hundred looked at.

    A community that never fills its quota has been read to its end.
    """
    cut = kept.groupBy(group).agg(
        F.count("*").alias("kept"), F.max(ordinal).alias("__last")
    ).withColumn("__full", F.col("kept") >= quota_column(group, quota))
    seen = df.select(group, ordinal).join(small_side(cut, "quota-cut"), group, "left")
    upto = ~F.coalesce(F.col("__full"), F.lit(False)) | (F.col(ordinal) <= F.col("__last"))
    return seen.filter(upto).groupBy(group).agg(
        F.count("*").alias("processed"), F.coalesce(F.max("kept"), F.lit(0)).alias("kept")
    ).withColumn("collection_rate", F.col("kept") / F.col("processed") * 100)


def _pick(df: DataFrame, cuts: DataFrame, groups: list[str], id_col: str, seed: int) -> DataFrame:
    """Rows up to their group's threshold: one pass over the full rows, no shuffle of them."""
    joined = null_safe_join(df, small_side(cuts, "cuts"), groups)
    return joined.filter(hash_key(id_col, seed) <= F.col("cut")).select(*df.columns)


def balance_classes(
    df: DataFrame, label: str = "label", id_col: str = "id", seed: int = 42
) -> DataFrame:
    """Downsample every class to the size of the smallest one, exactly. Rows without a label are no class."""
    df = df.filter(F.col(label).isNotNull())
    sizes = df.groupBy(label).count()
    smallest = sizes.agg(F.min("count").alias("n")).scalar()
    cuts = hash_cuts(df, [label], id_col, seed, lambda n: {"cut": smallest})
    return _pick(df, cuts, [label], id_col, seed)


def stratified_sample_n(
    df: DataFrame, group: str, quota: int | dict[str, int], id_col: str = "id", seed: int = 42
) -> DataFrame:
    """A reproducible random n rows per group, or all of a group that has fewer."""
    if isinstance(quota, dict):
        df = df.filter(F.col(group).isin(list(quota)))
    want = quota_column(group, quota)
    cuts = hash_cuts(df, [group], id_col, seed, lambda n: {"cut": F.least(want, n)})
    return _pick(df, cuts, [group], id_col, seed)


def redistribute_quota(
    df: DataFrame, group: str, quota: dict[str, int]
) -> DataFrame:
    """Quota table after a shortfall: each short group takes what it has, the rest share its deficit.

    Half of the total deficit (whole division by the number of full groups in general) is added to
    every group that can fill its own quota. One row per quota entry.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(quota.items()), f"{group} string, target long")
    have = df.filter(F.col(group).isin(list(quota))).groupBy(group).agg(
        F.count("*").alias("available")
    )
    t = wanted.join(have, group, "left").fillna(0, ["available"])
    t = t.withColumn("shortfall", F.greatest(F.col("target") - F.col("available"), F.lit(0)))
    totals = t.agg(
        F.struct(
            F.sum("shortfall").alias("gap"), F.count_if(F.col("shortfall") == 0).alias("full")
        ).alias("s")
    ).scalar()
    s = F.col("__s")
    extra = F.when(s["full"] > 0, F.floor(s["gap"] / s["full"])).otherwise(0)
    return t.withColumn("__s", totals).withColumn(
        "adjusted_target",
        F.when(F.col("shortfall") > 0, F.col("available")).otherwise(F.col("target") + extra)
        .cast("long"),
    ).drop("__s")


def dedup_keep_first(df: DataFrame, text: str, order: str = "id") -> DataFrame:
    """One row per text, the one with the smallest ``order``.

    Copies meet on a 256-bit digest and collapse map-side, so a text that makes up a third of the
    table reaches the shuffle as one row per task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("__digest")).agg(
        F.min_by(row, F.col(order)).alias("__row")
    )
    return kept.select("__row.*")


def duplicate_count(df: DataFrame, text: str) -> DataFrame:
    groups = df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("d")).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def split_sizes(n):
    """Held-out 30% rounded up, half of that rounded up for test; whole-number arithmetic."""
    held = F.floor((n * 30 + 99) / 100)
    return {"test_cut": F.floor((held + 1) / 2), "held_cut": held}


def stratified_split(
    df: DataFrame, label: str = "label", id_col: str = "id", seed: int = 42
) -> DataFrame:
    """70/15/15 per class by hash order: a ``split`` column with train, val or test.

    Rows without a label are a class of their own.
    """
    cuts = small_side(hash_cuts(df, [label], id_col, seed, split_sizes), "cuts")
    key = hash_key(id_col, seed)
    split = (
        F.when(key <= F.col("test_cut"), "test").when(key <= F.col("held_cut"), "val")
        .otherwise("train")
    )
    return null_safe_join(df, cuts, [label]).withColumn("split", split).select(*df.columns, "split")


def split_distribution(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Rows per split and class; rows without a label are counted in the column ``null``."""
    counts = [F.count_if(F.col(label) == c).alias(str(c)) for c in classes]
    return df.groupBy("split").agg(*counts, F.count_if(F.col(label).isNull()).alias("null"))


def random_cap_sample(
    df: DataFrame, k: int, id_col: str = "id", seed: int = 42, fast: bool = False
) -> DataFrame:
    """A reproducible random k rows for display; each task keeps its best k, one merge follows."""
    return df.orderBy(hash_order(F.col(id_col), seed, fast), F.col(id_col)).limit(k)


def head_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_rows(df: DataFrame, order: list) -> DataFrame:
    return df.orderBy(*order)
