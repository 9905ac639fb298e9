"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials use features of the line and of its two neighbours, and a
transition matrix ties the labels of consecutive lines. Forward-backward gives each line's marginal
probability of being good; the document's score is their mean, weighted by line length. Training takes
a bounded number of labelled documents, whose lines carry the label of the document.

Edge cases: null counts as empty; an empty text is one empty line and gets the score of such a line.
Without labels every score is 0.5. Texts of any length are scored whole, in memory that grows with one
Arrow batch. Columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the training sample, drawn by a hash of the id.
MAX_TRAIN_DOCS = 4000
ITERATIONS, RATE, RIDGE = 150, 0.1, 1e-3
UPPER, DIGIT, SPACE, STOP, SYMBOL, MORE = 1, 2, 3, 4, 5, 6
OWN_FEATURES = 11


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    for chars, k in ((b" \t\r\v\f\n", SPACE), (b".,;:!?'\"()-", STOP), (b"0123456789", DIGIT)):
        kind[list(chars)] = k
    kind[65:91] = UPPER
    for b in range(128):
        if kind[b] == 0 and not 97 <= b <= 122:
            kind[b] = SYMBOL
    kind[128:192] = MORE  # continuation bytes of a character
    return kind


KIND = _byte_kinds()


def _repetition(texts: list[str | None]) -> tuple[list[bool], list[float]]:
    """Per line: whether its text had the same line before, and the share of distinct words."""
    copied, varied = [], []
    for text in texts:
        seen: set[str] = set()
        for line in (text or "").split("\n"):
            words = line.split()
            varied.append(len(set(words)) / len(words) if words else 1.0)
            copied.append(bool(words) and line in seen)
            seen.add(line)
    return copied, varied


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, lines): features per line, characters per line, lines per text."""
    flat = np.frombuffer("".join((t or "") + "\n" for t in texts).encode(), dtype=np.uint8)
    if not len(flat):
        return np.zeros((0, OWN_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[flat]
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    size = ends - starts - count(kind == MORE)
    share = np.maximum(size, 1)
    # Words are the runs between white space; a separator belongs to the line that it ends or divides.
    gaps = np.flatnonzero(kind == SPACE)
    run = np.diff(np.concatenate([[-1], gaps])) - 1
    line_of = np.searchsorted(ends, gaps)
    words = np.bincount(line_of, weights=run > 0, minlength=len(ends))
    short = np.bincount(line_of, weights=(run > 0) & (run <= 3), minlength=len(ends))
    repeat = np.zeros(len(flat), dtype=bool)
    repeat[1:] = (flat[1:] == flat[:-1]) & (kind[1:] != 0) & (kind[1:] < MORE)
    lines = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
    copied, varied = _repetition(texts)
    per_word = np.maximum(words, 1)
    features = np.stack([
        np.log1p(size) / 5, count(kind == UPPER) / share, count(kind == DIGIT) / share, count(kind == STOP) / share,
        count(kind == SYMBOL) / share, count(repeat) / share, size / per_word / 10, short / per_word,
        np.log1p(count(kind == SYMBOL)) / 3, copied, varied,
    ], axis=1)
    return features.astype(np.float32), size, lines


def with_neighbours(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text, and marks of the ends."""
    n = len(features)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(lines)
    first[(ends - lines)[lines > 0]] = True
    last[(ends - 1)[lines > 0]] = True
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:] = features[:-1]
    after[:-1] = features[1:]
    before[first] = 0
    after[last] = 0
    return np.concatenate([features, before, after, first[:, None], last[:, None], np.ones((n, 1))], axis=1)


class Chain:
    """Two-state chain: unary log-odds of good per line, and a matrix of positive transition weights."""

    def __init__(self, lines: np.ndarray):
        self.lines, self.starts = lines, np.cumsum(lines) - lines
        self.order = np.argsort(-lines, kind="stable")  # so that the texts that have a line t are a prefix
        sorted_lines = lines[self.order]
        self.steps = int(sorted_lines[0]) if len(lines) else 0
        self.active = np.searchsorted(-sorted_lines, -np.arange(self.steps), side="left")
        self.at = [self.starts[self.order[:k]] + t for t, k in enumerate(self.active)]

    def marginals(self, log_odds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good per line, and the expected number of each transition."""
        good = 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))
        emit = np.stack([1 - good, good], axis=1)
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        for t, at in enumerate(self.at):
            a = emit[at] if t == 0 else emit[at] * (alpha[at - 1] @ weights)
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        moves = np.zeros((2, 2))
        for t in range(self.steps - 1, 0, -1):
            at = self.at[t]
            right = emit[at] * beta[at]
            b = right @ weights.T
            beta[at - 1] = b / b.sum(axis=1, keepdims=True)
            left = alpha[at - 1]
            both = left[:, :, None] * weights[None] * right[:, None, :]
            moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = alpha * beta
        return p[:, 1] / p.sum(axis=1), moves


class Model:
    """Weights of the features, their scaling, and the transition weights (as logs)."""

    def __init__(self) -> None:
        width = 3 * OWN_FEATURES + 3
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w, self.log_moves = np.zeros(width), np.zeros((2, 2))

    def fit(self, features: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Model:
        x = with_neighbours(features, lines)
        self.mean[:-1], self.scale[:-1] = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        chain, y = Chain(lines), np.repeat(label, lines).astype(float)
        stays = np.bincount(label, weights=np.maximum(lines - 1, 0), minlength=2)
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, ITERATIONS + 1):
            w, moves = theta[:-4], theta[-4:].reshape(2, 2)
            p, expected = chain.marginals(x @ w, np.exp(moves))
            g = np.concatenate([x.T @ (y - p), (np.diag(stays) - expected).ravel()]) / len(y) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + RATE * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
        self.w, self.log_moves = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def line_marginals(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        x = (with_neighbours(features, lines) - self.mean) / self.scale
        return Chain(lines).marginals(x @ self.w, np.exp(self.log_moves))[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        features, size, lines = line_features(texts)
        if not len(lines):
            return np.zeros(0)
        weight = np.maximum(size, 1)
        p = self.line_marginals(features, lines)
        at = np.cumsum(lines) - lines
        return np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0.0, 1.0)


def _packed_features(texts: pa.Array) -> pa.Array:
    features, _, lines = line_features(texts.to_pylist())
    ends = np.cumsum(lines)
    return pa.array([features[e - n:e].tobytes() for e, n in zip(ends, lines)], pa.binary())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Train on at most ``max_docs`` documents of ``labels``; features are made on the executors."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    picked = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("y", F.arrow_udf(_packed_features, T.BinaryType())("text").alias("f"))
    got = rows.orderBy(F.xxhash64("f")).limit(max_docs).toArrow()
    if not len(got):
        return Model()
    blocks = [np.frombuffer(b, dtype=np.float32).reshape(-1, OWN_FEATURES) for b in got["f"].to_pylist()]
    return Model().fit(np.concatenate(blocks), np.array([len(b) for b in blocks]), got["y"].to_numpy())


def score(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of scores between 0 and 1 for the texts of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda texts: pa.array(shared.value.score(texts.to_pylist())), T.DoubleType())(F.col(text_col))
