"""Request batches under a token and a row limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx


def token_budget_batches(
    df: DataFrame, tokens: str, order: str, shard: Column,
    max_tokens: int = lx.MAX_TOKENS_PER_REQUEST, max_rows: int = lx.MAX_ROWS_PER_REQUEST,
) -> DataFrame:
    """Greedy batches in ``order``: a batch is sealed when the next row would break a limit.

    Where a batch ends depends on all rows before it, so the order runs within a shard and shards run
    in parallel; choose them by blocks of the order column. A task streams its sorted rows and keeps
    two counters, whatever the size of a shard. A row beyond the token limit gets its own batch.
    """
    out = df.withColumn("shard", shard)
    schema = f"{out.schema.simpleString()[7:-1]},batch_no:int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, rows, used = None, 0, 0, 0
        for pdf in batches:
            numbers = []
            for key, n in zip(pdf["shard"].to_list(), pdf[tokens].to_list()):
                if key != current:
                    current, number, rows, used = key, 0, 0, 0
                elif used + n > max_tokens or rows >= max_rows:
                    number, rows, used = number + 1, 0, 0
                rows, used = rows + 1, used + n
                numbers.append(number)
            yield pdf.assign(batch_no=pd.Series(numbers, index=pdf.index, dtype="int32"))

    ordered = out.repartition("shard").sortWithinPartitions("shard", order)
    return ordered.mapInPandas(fold, schema)


def batch_summary(batched: DataFrame, tokens: str) -> DataFrame:
    return batched.groupBy("shard", "batch_no").agg(
        F.count("*").alias("n_rows"), F.sum(tokens).alias("n_tokens")
    )
