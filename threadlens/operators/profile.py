"""Counts, group statistics and distribution tables."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.project import flag_removed
from threadlens.operators.ranking import exact_quantiles, small_side
from threadlens.session import materialize


def value_counts(df: DataFrame, col: str) -> DataFrame:
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).count()
    return counts.orderBy(F.desc("count"), col)


def group_size(df: DataFrame, group: str, out: str = "n") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias(out))


def removed_summary(df: DataFrame, group: str, text: str, **kwargs) -> DataFrame:
    """Texts, flagged texts and the flagged share per community.

    The share divides by all rows, the total counts only rows that have a text.
    """
    flagged = flag_removed(df, text, **kwargs)
    hits = F.count_if("is_removed_deleted")
    return flagged.groupBy(group).agg(
        F.count(text).alias("total_posts"),
        hits.alias("removed_deleted_count"),
        F.format_string("%.2f%%", hits / F.count("*") * 100).alias("removed_deleted_percentage"),
    )


def group_feature_means(df: DataFrame, groups: list[str], features: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.avg(f).alias(f) for f in features])


def to_long(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """One row per (row, feature); lets one job cover all features."""
    cast = [F.col(f).cast("double").alias(f) for f in features]
    return df.select(*keep, *cast).unpivot(keep, features, "feature", "value")


def group_describe(
    df: DataFrame, groups: list[str], features: list[str], cut: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max of each feature per group, all exact.

    ``cut`` writes the narrow long table once when the features are costly to recompute.
    """
    long = to_long(df, groups, features)
    long = materialize(long, "long") if cut else long
    keys = ["feature", *groups]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75]).drop("n")
    named = q.select(*keys, *[
        F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))
    ])
    return moments.join(named, keys, "left")


def class_feature_ratio(
    df: DataFrame, features: list[str], label: str = "label", top: int = 1, bottom: int = 0
) -> DataFrame:
    """Feature means of two classes and their ratio, largest first."""
    cols = [
        F.avg(F.when(F.col(label) == cls, F.col(f))).alias(f"{f}|{cls}")
        for f in features for cls in (bottom, top)
    ]
    wide = df.agg(*cols)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f"`{f}|{bottom}`").alias(f"mean_{bottom}"),
            F.col(f"`{f}|{top}`").alias(f"mean_{top}"),
        ) for f in features
    ]))
    long = wide.select(rows.alias("r")).select("r.*")
    ratio = F.col(f"mean_{top}") / (F.col(f"mean_{bottom}") + 1e-10)
    return long.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "feature")


def class_histogram(
    df: DataFrame, label: str, feature: str, bins: int = 50, cap: float | None = 0.99,
    cut: bool = False,
) -> DataFrame:
    """Equal-width bins per class below the class's cap quantile, with counts and densities.

    Bins without rows are absent. The last bin is closed on both sides.
    """
    vals = df.select(label, F.col(feature).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & F.col(label).isNotNull()
    )
    if cap is not None:
        caps = exact_quantiles(vals, [label], "v", [cap], cut=cut)
        caps = small_side(caps.select(label, F.col("q")[0].alias("cap")), "caps")
        vals = vals.join(caps, label).filter(F.col("v") <= F.col("cap"))
    range_ = vals.groupBy(label).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")
    )
    # A constant feature gets a unit-wide range around its value.
    flat = F.col("lo") == F.col("hi")
    range_ = range_.select(
        label, "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width"),
    )
    placed = vals.join(small_side(range_, "ranges"), label)
    bin_no = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    out = placed.groupBy(label, bin_no.cast("int").alias("bin")).agg(
        F.count("*").alias("count"), F.max("n").alias("n"), F.max("lo").alias("lo"),
        F.max("width").alias("width"),
    )
    return out.select(
        label, "bin", "count",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("count") / (F.col("n") * F.col("width"))).alias("density"),
    )


def box_stats(df: DataFrame, label: str, feature: str, cut: bool = False) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR, and how many rows lie beyond them, per class."""
    vals = df.select(label, F.col(feature).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & F.col(label).isNotNull()
    )
    q = exact_quantiles(vals, [label], "v", [0.25, 0.5, 0.75], cut=cut).select(
        label, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    joined = vals.join(small_side(q, "quartiles"), label)
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return joined.groupBy(label).agg(
        F.count("*").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, label: str, feature: str, stats: DataFrame) -> DataFrame:
    """The rows beyond the whiskers, all of them."""
    bounds = stats.select(label, "whisker_low", "whisker_high")
    beyond = (F.col(feature) < F.col("whisker_low")) | (F.col(feature) > F.col("whisker_high"))
    return df.join(small_side(bounds, "whiskers"), label).filter(beyond).select(*df.columns)


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every feature pair, from one aggregation; pairs with a null are skipped."""
    pairs = list(combinations_with_replacement(features, 2))
    num = {f: F.col(f).cast("double") for f in features}
    cells = []
    for i, (a, b) in enumerate(pairs):
        both = num[a].isNotNull() & num[b].isNotNull()
        cells.append(F.corr(F.when(both, num[a]), F.when(both, num[b])).alias(f"c{i}"))
    wide = df.agg(*cells)
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(
                F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr")
            ))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def minmax_class_profile(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Class means scaled by the global range of each feature; 0.5 for a constant feature."""
    long = to_long(df, [label], features)
    per_class = long.groupBy("feature", label).agg(
        F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    ends = per_class.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    scaled = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(
        (F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    )
    return per_class.drop("lo", "hi").join(ends, "feature").filter(
        F.col(label).isNotNull()
    ).select("feature", label, scaled.alias("scaled_mean"))


def dataset_metrics(df: DataFrame, label: str = "label", words: str = "word_count") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(label) == 0).alias("agent_rows"),
        F.count_if(F.col(label) == 1).alias("human_rows"),
        F.min(words).alias("min_words"), F.max(words).alias("max_words"),
    )


def quantile_cap_impute(
    df: DataFrame, col: str, split: str = "split", cap: float = 0.99, cut: bool = False
) -> DataFrame:
    """Clip at the train quantile, then fill nulls with the unclipped train median."""
    train = df.filter(F.col(split) == "train")
    q = exact_quantiles(train, [], col, [cap, 0.5], cut=cut).agg(F.first("q").alias("q")).scalar()
    c = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    capped = F.when(c.isNull(), F.col("__q")[1]).otherwise(F.least(c, F.col("__q")[0]))
    return df.withColumn("__q", q).withColumn(col, capped).drop("__q")
