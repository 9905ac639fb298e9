"""Scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Texts hold newlines, quotes and meaningful blanks, so nothing is trimmed and "" differs from null.
_CSV = {
    "header": True,
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _texts(df: DataFrame, change) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[change(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns])


def sink_csv(df: DataFrame, path: str) -> str:
    """Write one CSV file per partition, with header, without an index column.

    A text that starts with a backslash gets a second one, so that none reads as the null marker.
    """
    df = _texts(df, lambda c: F.when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c))
    df.write.options(**_CSV).csv(path)
    return path


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read CSV written by ``sink_csv``, whose text fields may hold newlines, quotes and backslashes.

    A multi-line file is read by one task, so parallelism comes from the number of files.
    """
    df = spark.read.schema(schema).options(multiLine=True, **_CSV).csv(path)
    return _texts(df, lambda c: F.when(c.startswith("\\"), F.substring(c, F.lit(2), F.length(c))).otherwise(c))


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan that has fewer tasks than the cluster has cores, ahead of costly row work.

    A large table is split by the scan itself and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def sink_partitioned(df: DataFrame, path: str, by: str) -> str:
    df.write.partitionBy(by).parquet(path)
    return path


def scan_tagged_partitions(
    spark: SparkSession, path: str, schema: StructType | str, names: list[str] | None = None,
    tag: str = "subreddit",
) -> DataFrame:
    """Read a folder with one ``tag=`` sub-folder per community; the tag becomes a column.

    Asking for some communities prunes the other folders before any file is opened.
    """
    df = spark.read.schema(schema).parquet(path)
    return df.filter(F.col(tag).isin(names)) if names is not None else df


def scan_tagged_paths(
    spark: SparkSession, paths: dict[str, str], schema: StructType | str, tag: str = "subreddit"
) -> DataFrame:
    """Read one path per community and tag each row with the community it came from."""
    parts = [
        spark.read.schema(schema).parquet(p).withColumn(tag, F.lit(name))
        for name, p in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_checkpoints(
    spark: SparkSession, path: str, schema: StructType | str, temp_columns: tuple = ("safe_content",)
) -> DataFrame:
    """All part files below a folder as one table; an empty or missing folder gives an empty table."""
    try:
        df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.drop(*temp_columns)


def sink_feature_matrix(
    df: DataFrame, path: str, features: list[str], embedding: str = "embedding"
) -> dict[str, str]:
    """Full, tabular and tabular-plus-embedding tables, each partitioned by split."""
    keep = [c for c in ("label", "source", "split") if c in df.columns]
    views = {
        "full": df.columns,
        "tabular": features + keep,
        "tabular_embedding": features + [embedding] + keep,
    }
    out = {}
    for name, cols in views.items():
        out[name] = sink_partitioned(df.select(*cols), f"{path}/{name}", "split")
    return out


def sink_embedding_split(df: DataFrame, path: str, id_col: str = "id") -> str:
    return sink_partitioned(df.select(id_col, "embedding", "split"), path, "split")


def export_filtered_view(
    df: DataFrame, path: str, columns: list[str], limit: int | None = None
) -> str:
    """CSV of the display columns that exist; ``limit`` is the caller's table cap, if any."""
    view = df.select(*[c for c in columns if c in df.columns])
    return sink_csv(view.limit(limit) if limit is not None else view, path)
