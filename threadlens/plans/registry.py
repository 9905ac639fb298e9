"""Named queries over the test tables: a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(fn: Run) -> Run:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(key, fn, sql)
        return fn

    return register


def load() -> dict[str, Query]:
    from threadlens.plans import (  # noqa: F401
        borders, files, learned, metrics, models, profiles, samples, shapes, streams, textual, threads, vectors,
    )

    return QUERIES
