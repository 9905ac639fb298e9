"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions.text import WS, strip


def align_schema(df: DataFrame, renames: dict[str, str], columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed(renames).select(*columns)


def existing_columns_project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of every column, from one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def drop_columns_with_nulls(df: DataFrame, how: str = "any") -> DataFrame:
    """Drop columns with any null, or with nothing but nulls.

    Which columns stay is a schema question, so the one-row null count comes to the driver.
    """
    marks = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    counts = df.agg(F.count("*").alias("__rows"), *marks).first().asDict()
    n = counts.pop("__rows")
    if how == "any":
        keep = [c for c in df.columns if counts[c] == 0]
    else:
        keep = [c for c in df.columns if counts[c] < n or n == 0]
    return df.select(*keep)


def null_profile(df: DataFrame) -> DataFrame:
    """Column name, null count and whether the column has nulls."""
    wide = null_counts(df)
    long = wide.unpivot([], wide.columns, "column_name", "null_count")
    return long.withColumn("has_nulls", F.col("null_count") > 0)


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def filter_invalid_markers_exact(
    df: DataFrame, col: str, markers: list[str] = lx.INVALID_MARKERS
) -> DataFrame:
    """Drop null texts and texts equal to a marker, case-sensitively."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(markers))


def is_clean(col: str, markers: list[str] = lx.INVALID_MARKERS) -> Column:
    """Not blank, and no marker anywhere in the lower-cased text; null is not clean."""
    c = F.col(col)
    ok = c.rlike(f"[^{WS}]")
    low = F.lower(c)
    for m in markers:
        ok = ok & ~F.contains(low, F.lit(m.lower()))
    return F.coalesce(ok, F.lit(False))


def filter_clean_posts(
    df: DataFrame, col: str, markers: list[str] = lx.INVALID_MARKERS
) -> DataFrame:
    return df.filter(is_clean(col, markers))


def flag_removed(
    df: DataFrame, col: str, markers: list[str] = lx.INVALID_MARKERS,
    out: str = "is_removed_deleted",
) -> DataFrame:
    low = F.lower(F.col(col))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(low, F.lit(m.lower()))
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))


def filter_communities(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    return df.filter(F.col(col).isin(keep))


def filter_time_range(df: DataFrame, col: str, start, end) -> DataFrame:
    return df.filter(F.col(col).between(F.lit(start), F.lit(end)))


def filter_recent_window(df: DataFrame, col: str, days: int = 12) -> DataFrame:
    """Rows within ``days`` of the newest row; the bound is a scalar subquery, not a join."""
    start = F.expr(f"INTERVAL {days} DAYS")
    newest = df.agg(F.max(col).alias("newest")).scalar()
    return df.filter(F.col(col) >= newest - start)


def filter_min_length(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    return df.filter(F.length(col) >= n)


def explore_filter(
    df: DataFrame, word_range: tuple[int, int], communities: list[str] | None = None,
    keyword: str | None = None, community_col: str = "community", text_col: str = "text",
    author_col: str = "author",
) -> DataFrame:
    """Word-count range, community set (ignored when empty) and a literal keyword in text or author."""
    out = df.filter(F.col("word_count").between(*word_range))
    if communities and community_col in df.columns:
        out = out.filter(F.col(community_col).isin(communities))
    if keyword:
        hit = F.lit(False)
        for c in (text_col, author_col):
            if c in df.columns:
                low = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
                hit = hit | F.contains(low, F.lit(keyword.lower()))
        out = out.filter(hit)
    return out


def net_score(df: DataFrame, up: str = "upvotes", down: str = "downvotes") -> DataFrame:
    return df.withColumn("score", F.col(up) - F.col(down))


def tag_constants(df: DataFrame, **tags) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def is_comment_flag(df: DataFrame, col: str = "interaction_type") -> DataFrame:
    flag = F.coalesce(F.col(col) == "comment", F.lit(False))
    return df.withColumn("is_comment", flag.cast("int"))


def reject_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(strip(F.col(col)) != "")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Bag union; columns missing on one side become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


META_COLUMNS = [
    "text", "text_clean", "author", "created_utc", "timestamp", "subreddit", "community", "source",
    "label", "split", "interaction_type", "id", "post_id", "embedding",
]
# Left out on top of the above when a model is trained.
MODEL_EXCLUDED = ["is_comment", "hour_of_day", "day_of_week"]


def feature_columns(df: DataFrame, for_model: bool = False) -> list[str]:
    """Columns that are features: not metadata, not the embedding; numeric only for models."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    skip = set(META_COLUMNS) | (set(MODEL_EXCLUDED) if for_model else set())
    return [
        name for name, kind in df.dtypes
        if name not in skip
        and not name.startswith("emb_")
        and (not for_model or kind in numeric or kind.startswith("decimal"))
    ]
