"""Structured Streaming forms of the collection and pacing operators.

Sinks write one folder per micro-batch and overwrite it when a batch is replayed, so a restart from
the checkpoint gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, DateType, StructField, StructType

from threadlens.functions import lexicons as lx
from threadlens.operators.authors import inter_post_gap
from threadlens.operators.project import filter_clean_posts, is_clean
from threadlens.operators.ranking import top_n_per_group
from threadlens.session import fresh_path


def replay(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet",
           per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder; ``folder`` may be a pattern of files and of folders of part files."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_trigger).parquet(folder)
    )


def _drain(writer, spark: SparkSession, name: str) -> None:
    """Process what is available and stop."""
    q = writer.option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint")).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream into parquet and return the written table."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    _drain(df.writeStream.format("parquet").option("path", path), spark, name)
    return spark.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, name: str, mode: str, keep_all: bool = True) -> DataFrame:
    """Run an update- or complete-mode stream; column ``batch`` says which micro-batch wrote a row.

    ``keep_all`` off returns the newest batch only, the current result of a complete-mode query.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _drain(df.writeStream.outputMode(mode).foreachBatch(write), spark, name)
    schema = StructType(list(df.schema.fields)).add("batch", "long")
    out = spark.read.schema(schema).parquet(path)
    if keep_all:
        return out
    newest = out.agg(F.max("batch").alias("b")).scalar()
    return out.filter(F.col("batch") == newest).drop("batch")


def stream_clean_filter(stream: DataFrame, text: str, markers: list[str] = lx.INVALID_MARKERS) -> DataFrame:
    """Clean posts of a stream; stateless."""
    return filter_clean_posts(stream, text, markers)


def stream_group_quota(
    stream: DataFrame, group: str, ordinal: str, quota: int, salts: int = 32
) -> DataFrame:
    """Candidates for the first ``quota`` rows of each group, in whatever order they arrive.

    State is the least ``quota`` ordinals so far per (group, salt), so a large group spreads over
    ``salts`` keys. A key keeps at most ``quota`` rows of a micro-batch in memory and, once it is full, only
    emits rows that come before its largest ordinal. The exact first rows follow from the written
    candidates with ``finish_group_quota``.
    """
    salted = stream.withColumn("__salt", F.pmod(F.xxhash64(ordinal), F.lit(salts)).cast("int"))

    columns = stream.columns

    def take(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = list(state.get[0]) if state.exists else []
        best = None
        for pdf in batches:
            if len(least) == quota:
                pdf = pdf[pdf[ordinal] < least[-1]]
            best = pdf if best is None else pd.concat([best, pdf])
            best = best.nsmallest(quota, ordinal)
        new = [] if best is None else best[ordinal].tolist()
        # Earlier rows go first among equals; the new ones that stay are the first of ``best``.
        merged = sorted([(x, 0) for x in least] + [(x, 1) for x in new])[:quota]
        state.update(([x for x, _ in merged],))
        taken = sum(fresh for _, fresh in merged)
        if taken:
            yield best[columns].head(taken)

    kept = StructType([StructField("least", ArrayType(stream.schema[ordinal].dataType))])
    return salted.groupBy(group, "__salt").applyInPandasWithState(
        take, stream.schema, kept, "append", GroupStateTimeout.NoTimeout
    )


def finish_group_quota(candidates: DataFrame, group: str, ordinal: str, quota: int) -> DataFrame:
    return top_n_per_group(candidates, group, [F.asc(ordinal)], quota, ordinal)


def stream_minute_budget(
    stream: DataFrame, ts: str, tokens: str, budget: int = lx.TOKENS_PER_MINUTE,
    lateness: str | None = None,
) -> DataFrame:
    """Tokens per minute and whether they exceed the budget.

    The state is one row a minute, and rows of any age count. ``lateness`` bounds it by a watermark; rows
    that are further behind are then dropped.
    """
    kind = dict(stream.dtypes)[ts]
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark(ts, lateness)
    windows = timed.groupBy(F.window(ts, "1 minute")).agg(
        F.count("*").alias("requests"), F.sum(tokens).alias("tokens")
    )
    return windows.select(
        F.col("window.start").cast(kind).alias("minute"), "requests", "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def latest_windows(written: DataFrame, key: str = "minute") -> DataFrame:
    """Last state of every window of an update-mode run."""
    cols = [c for c in written.columns if c not in (key, "batch")]
    return written.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(key, "r.*")


def stream_scan_counters(
    stream: DataFrame, group: str, text: str, markers: list[str] = lx.INVALID_MARKERS
) -> DataFrame:
    """Running processed and clean counts per community, for complete mode."""
    return stream.groupBy(group).agg(
        F.count("*").alias("processed"), F.count_if(is_clean(text, markers)).alias("clean")
    )


def stream_inter_post_gap(stream: DataFrame, name: str = "gaps") -> DataFrame:
    """Hours since the author's previous post, over micro-batches of (author, timestamp, id), in any order of arrival.

    The result equals the batch operator over all rows. Cells of (author, day) are what is worked out anew: those that a
    micro-batch adds to, and the author's next cell after each, whose first row gets another predecessor by a late row. A cell starts
    from the last row of the author's cell before it, known from a table with one row per cell. Rows seen so far are kept by day, so
    only the days of such cells are read again; in a stream without disorder these are the newest ones.

    A row that is older than its author's newest one in earlier micro-batches is flagged ``late``. Every micro-batch
    writes under its own number and reads what smaller numbers have written, so a replay gives the same. A cell's rows are
    taken from the newest micro-batch that worked it out. Null authors are one author; null times come before all others.
    """
    spark = stream.sparkSession
    path, seen, state = fresh_path(spark, name), fresh_path(spark, f"{name}-seen"), fresh_path(spark, f"{name}-state")
    rows = stream.select("author", "timestamp", "id")
    kind = rows.schema
    seen_schema = StructType([*kind.fields, StructField("late", BooleanType()), StructField("day", DateType())])
    cells_schema = StructType([
        StructField("cell", StructType([kind["author"], StructField("day", DateType())])),
        StructField("last", StructType([kind["timestamp"], kind["id"]]))])
    cell = F.struct("author", "day").alias("cell")

    def earlier(folder: str, number: int, schema: StructType, newest: bool) -> DataFrame:
        if not number:
            return spark.createDataFrame([], schema)
        paths = [f"{folder}/{k}" for k in ([number - 1] if newest else range(number))]
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p) for p in paths])

    def write(batch: DataFrame, number: int) -> None:
        before = earlier(state, number, cells_schema, newest=True)
        newest = before.groupBy(F.col("cell.author").alias("__author")).agg(F.max("last.timestamp").alias("__newest"))
        marked = batch.join(newest, F.col("author").eqNullSafe(F.col("__author")), "left").select(
            *batch.columns, F.coalesce(F.col("timestamp") < F.col("__newest"), F.lit(False)).alias("late"),
            F.to_date("timestamp").alias("day"))
        marked.write.mode("overwrite").partitionBy("day").parquet(f"{seen}/{number}")
        new = spark.read.schema(seen_schema).parquet(f"{seen}/{number}")
        added = new.groupBy(cell).agg(F.max(F.struct("timestamp", "id")).alias("last"))
        after = before.unionByName(added).groupBy("cell").agg(F.max("last").alias("last"))
        after.write.mode("overwrite").parquet(f"{state}/{number}")
        order = Window.partitionBy("cell.author").orderBy(F.col("cell.day").asc_nulls_first())
        cells = spark.read.schema(cells_schema).parquet(f"{state}/{number}").join(
            added.select("cell", F.lit(True).alias("added")), "cell", "left")
        cells = cells.withColumn("again", F.coalesce("added", F.lag("added").over(order)))
        cells = cells.withColumn("carried", F.when(F.col("again") & F.lag("again").over(order).isNull(), F.lag("cell").over(order)))
        cells = cells.withColumn("carried_last", F.when(F.col("carried").isNotNull(), F.lag("last").over(order)))
        again = cells.filter("again").select("cell")
        known = earlier(seen, number, seen_schema, newest=False).unionByName(new).withColumn("cell", cell)
        known = known.join(again, "cell", "left_semi").select(*kind.names, "late", F.lit(False).alias("__carried"))
        carried = cells.filter("carried IS NOT NULL").select(
            F.col("carried.author").alias("author"), "carried_last.timestamp", "carried_last.id",
            F.lit(False).alias("late"), F.lit(True).alias("__carried"))
        gaps = inter_post_gap(known.unionByName(carried)).filter(~F.col("__carried"))
        gaps.select(*kind.names, "late", "gap_hours").write.mode("overwrite").parquet(f"{path}/batch={number}")

    _drain(rows.writeStream.foreachBatch(write), spark, name)
    schema = StructType(list(kind.fields)).add("late", "boolean").add("gap_hours", "double")
    out = spark.read.schema(schema.add("batch", "long")).parquet(path)
    out = out.withColumn("cell", F.struct("author", F.to_date("timestamp").alias("day")))
    newest = out.groupBy("cell").agg(F.max("batch").alias("__newest"))
    return out.join(newest, "cell").filter(F.col("batch") == F.col("__newest")).drop("batch", "cell", "__newest")
