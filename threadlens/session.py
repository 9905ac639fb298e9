"""Session settings and the shared scratch folder used for checkpoints and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Per-group quotas go beyond the default of 1,000 rows that the map-side limit covers.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "threadlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling).

    ``master`` stays unset on a cluster, where the submit command names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session, where driver and executors are one process, may fall back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="threadlens-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call has handed out."""
    return f"{shared_root(spark)}/threadlens/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, unlike blocks held by them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: a worker and its executor hold a few copies of one, and texts have any length.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Cut the Arrow batches of this session by bytes, unless the session names a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)
