"""Toxicity grades by cumulative-link (proportional odds) regression on sparse text features.

A text has one linear score from the words it holds; grade thresholds cut the same score, so all grades
share the weights: P(grade <= k) = sigmoid(threshold_k - score). The output is the expected grade
(severity), the likeliest grade, and the probability of any toxicity. A word of the vocabulary gives two
features: its presence, and the log of its rate per thousand words. The vocabulary holds the
``MAX_WORDS`` words that differ most between graded and clean training texts (chi-square).

Where only a 0/1 label exists, ``weak_grades`` makes grades from it: 0 for clean texts, and for toxic
ones the third of the rate of telling words that they fall into.

Edge cases: null counts as empty, and an empty text has the score of no words. Without labels, or with
one class only, everything is clean. Rows that repeat are scored alike; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRAIN_DOCS = 20_000
MAX_WORDS = 2000
#: Chi-square of one degree of freedom that chance exceeds once in some 10^6 words.
MIN_CHI2 = 24.0
ITERATIONS, RATE, RIDGE = 300, 0.05, 1e-4
GRADES = 4
_SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of letters; characters beyond ASCII count as letters."""
    return (text or "").lower().encode().translate(_SPLIT).split()


def _distinct_words(texts: pa.Array) -> pa.Array:
    return pa.array([[w.decode() for w in set(words_of(t))] for t in texts.to_pylist()], pa.list_(pa.string()))


class Model:
    def __init__(self, vocabulary: list[str], telling: list[bool] = ()):
        self.index = {w.encode(): i for i, w in enumerate(vocabulary)}
        self.telling = np.array(telling, dtype=bool)
        self.w, self.cuts = np.zeros(2 * len(vocabulary)), np.array([])

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the sparse features."""
        row, col, val = [], [], []
        known = self.index.keys()
        for i, t in enumerate(texts):
            words = words_of(t)
            for w in known & set(words):
                j = self.index[w]
                row += (i, i)
                col += (j, j + len(known))
                val += (1.0, np.log1p(1000 * words.count(w) / len(words)))
        return np.array(row, dtype=np.int64), np.array(col, dtype=np.int64), np.array(val)

    def telling_rate(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """Telling words per thousand words of each text."""
        width = len(self.index)
        own = col >= width
        own[own] &= self.telling[col[own] - width]
        return np.bincount(row[own], weights=np.expm1(val[own]), minlength=n)

    def fit(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int) -> Model:
        """Maximum likelihood with a ridge, by Adam; thresholds are kept apart through log differences."""
        n, p = len(grade), len(self.w)
        share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
        start = np.log(share / (1 - share))
        theta = np.concatenate([np.zeros(p), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        at = np.arange(n)
        for i in range(1, ITERATIONS + 1):
            gaps = np.exp(theta[p + 1:])
            cuts = theta[p] + np.concatenate([[0], np.cumsum(gaps)])
            score = np.bincount(row, weights=val * theta[:p][col], minlength=n)
            below = np.concatenate([np.zeros((n, 1)), sigmoid(cuts[None] - score[:, None]), np.ones((n, 1))], axis=1)
            slope = below * (1 - below)
            high, low = slope[at, grade + 1], slope[at, grade]
            mass = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
            by_cut = np.zeros((n, grades + 1))
            by_cut[at, grade + 1] += high / mass
            by_cut[at, grade] -= low / mass
            g_cut = by_cut[:, 1:-1].sum(axis=0)
            tail = np.cumsum(g_cut[::-1])[::-1]
            g = np.concatenate([
                np.bincount(col, weights=val * (-(high - low) / mass)[row], minlength=p), tail[:1], tail[1:] * gaps,
            ]) / n
            g[:p] -= RIDGE * theta[:p]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + RATE * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
        self.w, self.cuts = theta[:p], theta[p] + np.concatenate([[0], np.cumsum(np.exp(theta[p + 1:]))])
        return self

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(severity, grade, probability of a grade above 0)."""
        n = len(texts)
        if not len(self.cuts):
            return np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n)
        row, col, val = self.features(texts)
        score = np.bincount(row, weights=val * self.w[col], minlength=n)
        above = 1 / (1 + np.exp(np.clip(self.cuts[None] - score[:, None], -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        return above.sum(axis=1), (edges[:, :-1] - edges[:, 1:]).argmax(axis=1), above[:, 0]


def weak_grades(toxic: np.ndarray, rate: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 1 to ``grades`` - 1 of toxic texts by equal shares of their rate of telling words."""
    out = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(rate[toxic], np.arange(1, grades - 1) / (grades - 1))
        out[toxic] = 1 + np.searchsorted(cuts, rate[toxic], side="right")
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        grades: int = GRADES, max_docs: int = MAX_TRAIN_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Train on at most ``max_docs`` labelled documents, drawn by a hash of the id.

    A label above 1 is taken as a grade as it is; labels of 0 and 1 get weak grades.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y >= 0 AND id IS NOT NULL")
    picked = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id")
    sizes = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model([])
    words = rows.select((F.col("y") > 0).cast("long").alias("toxic"), F.explode(F.arrow_udf(_distinct_words, T.ArrayType(T.StringType()))("text")).alias("word"))
    seen = words.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    t, c = float(sizes[True]), float(sizes[False])
    both = F.col("a") + F.col("b")
    chi2 = (t + c) * F.pow(F.col("a") * c - F.col("b") * t, F.lit(2.0)) / (t * c * both * (t + c - both + 1e-9))
    top = seen.select("word", chi2.alias("chi2"), (F.col("a") * c > 4 * F.col("b") * t).alias("telling")).filter(F.col("chi2") > MIN_CHI2)
    got = top.orderBy(F.desc("chi2"), "word").limit(max_words).collect()
    model = Model([r["word"] for r in got], [r["telling"] for r in got])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def packed(batch: pa.Array) -> pa.Array:
        row, col, val = shared.value.features(batch.to_pylist())
        cut = np.searchsorted(row, np.arange(len(batch) + 1))
        parts = [{"c": col[a:b].tolist(), "v": val[a:b].tolist()} for a, b in zip(cut, cut[1:])]
        return pa.array(parts, pa.struct([("c", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))]))

    kind = T.StructType([T.StructField("c", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))])
    sample = rows.select("y", F.arrow_udf(packed, kind)("text").alias("f")).orderBy(F.xxhash64("f", "y")).limit(max_docs).toArrow()
    y, parts = sample["y"].to_numpy(), sample["f"].to_pylist()
    row = np.repeat(np.arange(len(parts)), [len(p["c"]) for p in parts])
    col = np.array([x for p in parts for x in p["c"]], dtype=np.int64)
    val = np.array([x for p in parts for x in p["v"]], dtype=np.float64)
    grade = np.minimum(y, grades - 1) if y.max() > 1 else weak_grades(y > 0, model.telling_rate(row, col, val, len(y)), grades)
    return model.fit(row, col, val, grade.astype(np.int64), grades)


def grade(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column struct<severity: double, grade: int, p_toxic: double> for the texts of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        severity, level, p = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(severity), pa.array(level.astype(np.int32)), pa.array(p)], names=["severity", "grade", "p_toxic"])

    kind = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())])
    return F.arrow_udf(run, kind)(F.col(text_col))
