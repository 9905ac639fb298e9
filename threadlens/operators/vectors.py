"""Operators on embedding and feature vectors."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.authors import cluster_size
from threadlens.operators.ranking import small_side
from threadlens.operators.sampling import random_cap_sample
from threadlens.session import materialize


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def group_centroid(
    df: DataFrame, group: str, vec: str = "embedding", out: str = "centroid"
) -> DataFrame:
    """Element-wise mean per group; tasks merge one running mean per group, never the vectors."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    return df.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias(out))


def centroid_homogeneity(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean cosine between the members of a group and the group's centroid."""
    centers = small_side(group_centroid(df, group, vec), "centroids", max_rows=10_000)
    joined = df.join(centers, group)
    return joined.groupBy(group).agg(
        F.avg(cosine(F.col(vec), F.col("centroid"))).alias("homogeneity"),
        F.count("*").alias("n"),
    )


def finite(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(x)


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant feature becomes 0.

    The moments are one row and enter as a scalar subquery, evaluated once into a column.
    """
    clean = df.withColumns({f: finite(F.col(f)) for f in features})
    cells = [c for f in features for c in (
        F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")
    )]
    names = [n for f in features for n in (f"m_{f}", f"s_{f}")]
    moments = clean.agg(*cells).select(F.struct(*names).alias("m")).scalar()
    m = F.col("__m")
    return clean.withColumn("__m", moments).withColumns({
        f: F.when(m[f"s_{f}"] > 0, (F.col(f) - m[f"m_{f}"]) / m[f"s_{f}"]).otherwise(0.0)
        for f in features
    }).drop("__m")


def pca_project(df: DataFrame, vector: str, k: int = 2, out: str = "pc") -> tuple[DataFrame, float]:
    """Centred principal components as columns pc1..pck, and the share of variance they keep.

    Only the mean and the component matrix (dimension by k) reach the driver. Each component's sign
    is fixed so that its largest loading is positive.
    """
    mean = df.agg(Summarizer.mean(F.col(vector)).alias("m")).first()["m"].toArray()
    model = PCA(k=k, inputCol=vector, outputCol="__pca").fit(df)
    load = model.pc.toArray()
    flip = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in load.T]
    shift = mean @ load
    projected = model.transform(df)
    pcs = vector_to_array("__pca")
    cols = {
        f"{out}{i + 1}": (pcs[i] - float(shift[i])) * flip[i] for i in range(k)
    }
    explained = float(sum(model.explainedVariance.toArray()))
    return projected.withColumns(cols).drop("__pca"), explained


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Features as one ML vector; nulls and non-finite values count as 0."""
    clean = df.select("*", *[finite(F.col(f)).alias(f"__f_{f}") for f in features])
    made = VectorAssembler(inputCols=[f"__f_{f}" for f in features], outputCol=out).transform(clean)
    return made.drop(*[f"__f_{f}" for f in features])


def best_kmeans(df: DataFrame, vector: str, k: int, inits: int = 10, seed: int = 42):
    """The k-means model with the smallest training cost over several seeds."""
    models = [
        KMeans(k=k, seed=seed + i, featuresCol=vector, predictionCol="cluster_id").fit(df)
        for i in range(inits)
    ]
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_clusters(
    df: DataFrame, features: list[str], k: int = 5, dims: int = 2, label_col: str = "label",
    label: int = 0, sample_size: int | None = None, id_col: str = "id", seed: int = 42, inits: int = 10,
) -> tuple[DataFrame | None, float | str]:
    """Cluster map of one class: z-scores, PCA to ``dims``, k-means on the projected points.

    Returns the rows with pc1.., cluster_id and cluster_size plus the explained variance, or None and
    one of the codes NO_LABEL_COLUMN, NO_AI_ROWS, INSUFFICIENT_NUMERIC_FEATURES,
    NOT_ENOUGH_AI_SAMPLES. ``sample_size`` is the caller's display sample; unset means all rows.
    """
    if label_col not in df.columns:
        return None, "NO_LABEL_COLUMN"
    rows = df.filter(F.col(label_col) == label)
    n = rows.count()
    if n == 0:
        return None, "NO_AI_ROWS"
    use = [f for f in features if f in rows.columns]
    if len(use) < dims:
        return None, "INSUFFICIENT_NUMERIC_FEATURES"
    if sample_size is not None:
        rows, n = random_cap_sample(rows, sample_size, id_col, seed), min(n, sample_size)
    if n < dims + 1:
        return None, "NOT_ENOUGH_AI_SAMPLES"
    raw = materialize(assemble(rows.select(id_col, *use), use).select(id_col, "features"), "features")
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(raw)
    points, explained = pca_project(scaler.transform(raw).select(id_col, "scaled"), "scaled", dims)
    names = [f"pc{i + 1}" for i in range(dims)]
    # The scaler divides by the sample deviation; the population deviation differs by one factor.
    fix = math.sqrt(n / (n - 1))
    points = materialize(points.select(id_col, *[(F.col(p) * fix).alias(p) for p in names]), "points")
    points = assemble(points, names, "point").persist()
    model = best_kmeans(points, "point", max(2, min(k, n - 1)), inits, seed)
    placed = model.transform(points).drop("point")
    points.unpersist()
    return cluster_size(rows.join(placed, id_col)), explained

