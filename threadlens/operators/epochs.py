"""A text classifier that is trained epoch by epoch, with patience and restored best weights.

Texts are hashed TF-IDF vectors of unit length, written once as the slots and values that are not zero. An epoch is one pass over
the table: every task sums the gradient of its training rows and the hits of its validation rows at the current weights, and
the sums combine by slot. The driver holds one number per slot, whatever the size of the corpus, and moves the weights by Adam. Gradients
are whole-corpus sums, so a run does not depend on how rows are dealt out, but for the order of floating-point sums.

Edge cases: null and empty texts have no slots and are classified by the intercept alone. Rows with a null label or a split other than
train and val take no part in fitting. Without validation rows every epoch counts as no better, and training stops after ``patience``
epochs with the first epoch's weights; without training rows the weights stay zero and every text is class 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import text
from threadlens.operators.modelfeat import _slots, slot_weights, token_slices
from threadlens.session import materialize

SUMS = "slot int, total double, rows bigint"
#: Slots of the sums that are no feature: intercept, training loss, validation hits.
INTERCEPT, LOSS, HITS = -1, -2, -3
VECTOR = T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _hashed(df: DataFrame, text_col: str, idf: np.ndarray, out: str) -> DataFrame:
    """Add the sparse unit vector of the text."""

    def vector_slice(lists: pa.Array) -> pa.Array:
        size = np.asarray(lists.value_lengths()).astype("int64")
        cell = np.repeat(np.arange(len(lists)), size) * len(idf) + np.asarray(lists.flatten()).astype("int64")
        cell, tf = np.unique(cell, return_counts=True)
        row, slot = cell // len(idf), cell % len(idf)
        value = (1 + np.log(tf)) * idf[slot]
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))
        offsets = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(offsets, pa.array(slot, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(value / norm[row]))], ["slots", "values"])

    @F.arrow_udf(VECTOR)
    def vector(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([vector_slice(part) for part in token_slices(lists)])

    return df.withColumn(out, vector(_slots(text.words(F.lower(F.coalesce(F.col(text_col), F.lit("")))))))


def _margins(vectors: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margin per row; row, slot and value of every entry)."""
    slots = vectors.field("slots")
    size = np.asarray(slots.value_lengths()).astype("int64")
    row, slot = np.repeat(np.arange(len(vectors)), size), np.asarray(slots.flatten())
    value = np.asarray(vectors.field("values").flatten())
    return np.bincount(row, weights[slot] * value, minlength=len(vectors)) + bias, row, slot, value


@dataclass
class TextClassifier:
    """Document frequencies and weights; class 1 above a margin of 0."""

    idf: np.ndarray
    weights: np.ndarray
    bias: float

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Add ``prediction`` and ``probability`` (of class 1)."""
        weights, bias = self.weights, self.bias

        @F.arrow_udf(T.DoubleType())
        def margin(vectors: pa.Array) -> pa.Array:
            return pa.array(_margins(vectors, weights, bias)[0])

        rows = _hashed(df, text_col, self.idf, "__v").withColumn("__m", margin("__v"))
        return rows.withColumns({
            "prediction": (F.col("__m") > 0).cast("double"), "probability": 1 / (1 + F.exp(-F.col("__m")))}).drop("__v", "__m")


def _pass(rows: DataFrame, weights: np.ndarray, bias: float) -> dict[int, tuple[float, int]]:
    """Sums over all rows at the given weights: gradient per slot, loss, and hits among validation rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, bias_gradient, loss, n, hits, checked = np.zeros(len(weights)), 0.0, 0.0, 0, 0, 0
        for batch in batches:
            y, train = np.asarray(batch["label"]), np.asarray(batch["is_train"].cast(pa.int8())) > 0
            z, row, slot, value = _margins(batch["vector"], weights, bias)
            error = np.where(train, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
            gradient += np.bincount(slot, error[row] * value, minlength=len(weights))
            bias_gradient += error.sum()
            loss += np.logaddexp(0, np.where(y > 0, -z, z))[train].sum()
            n += int(train.sum())
            hits += int(((z > 0) == (y > 0))[~train].sum())
            checked += int((~train).sum())
        used = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays([
            pa.array([*used.tolist(), INTERCEPT, LOSS, HITS], pa.int32()),
            pa.array([*gradient[used].tolist(), bias_gradient, loss, float(hits)]),
            pa.array([0] * len(used) + [n, n, checked], pa.int64())], ["slot", "total", "rows"])

    summed = rows.mapInArrow(sums, SUMS).groupBy("slot").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    return {r["slot"]: (r["total"], r["rows"]) for r in summed.collect()}


def train_by_epochs(
    df: DataFrame, text_col: str, label: str = "label", split: str = "split", epochs: int = 20, patience: int = 3, rate: float = 0.3,
) -> tuple[TextClassifier, DataFrame]:
    """Train on the split ``train`` until ``patience`` epochs in a row have not reached the best accuracy on ``val``.

    An equal accuracy counts as better. Returns the classifier with the best epoch's weights, and one row per epoch:
    ``epoch, score`` (validation accuracy) and ``loss`` (mean training loss).
    """
    train = df.filter((F.col(split) == "train") & F.col(label).isNotNull())
    idf = slot_weights(train, text_col)
    used = df.filter(F.col(split).isin("train", "val") & F.col(label).isNotNull())
    rows = _hashed(used, text_col, idf, "vector").select(
        F.col(label).cast("double").alias("label"), (F.col(split) == "train").alias("is_train"), "vector")
    rows = materialize(rows, "epoch-rows")
    weights = np.zeros(len(idf) + 1)
    mean, square, table, best, stale = np.zeros_like(weights), np.zeros_like(weights), [], None, 0
    sums = _pass(rows, weights[:-1], weights[-1])
    for epoch in range(1, epochs + 1):
        n = sums.get(INTERCEPT, (0.0, 0))[1]
        if not n:
            break
        gradient = np.zeros_like(weights)
        for slot, (total, _) in sums.items():
            if slot >= INTERCEPT:
                gradient[slot] = total / n
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient ** 2
        step = mean / (1 - 0.9 ** epoch) / (np.sqrt(square / (1 - 0.999 ** epoch)) + 1e-8)
        weights = weights - rate * step
        sums = _pass(rows, weights[:-1], weights[-1])
        hits, checked = sums[HITS]
        score = hits / checked if checked else None
        table.append((epoch, score, sums[LOSS][0] / n))
        if best is None or (score is not None and score >= best[0]):
            best, stale = (score if score is not None else 2.0, weights), 0
        else:
            stale += 1
            if stale >= patience:
                break
    kept = best[1] if best else weights
    frame = df.sparkSession.createDataFrame(table, "epoch int, score double, loss double")
    return TextClassifier(idf, kept[:-1], float(kept[-1])), frame
