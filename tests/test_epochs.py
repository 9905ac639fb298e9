"""Training by epochs: learning, patience, restored weights, edge rows."""

import random

import numpy as np
import pytest

from threadlens.operators import epochs, metrics

A, B = "hello friend sunny walk dog".split(), "buy now limited offer click".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [
        (i, " ".join(rng.choices(A if i % 2 else B, k=5) + [f"w{rng.randrange(400)}"]), i % 2, ("train", "train", "val", "test")[i % 4 if i % 3 else 0])
        for i in range(240)]
    made += [(900, None, 1, "test"), (901, "", 0, "train"), (902, "hello", None, "train"), (903, "hello", 1, None), (0, "hello dog", 1, "train")]
    return spark.createDataFrame(made, "id int, text string, label int, split string")


def test_learns_and_keeps_the_best_epoch(rows):
    model, table = epochs.train_by_epochs(rows, "text", epochs=8)
    scored = model.transform(rows.filter("split = 'test' and text is not null")).toPandas()
    assert (scored["prediction"] == scored["label"]).mean() > 0.95
    assert ((scored["probability"] > 0.5) == (scored["prediction"] == 1)).all()
    marked = metrics.select_best_epoch(table).toPandas()
    assert marked["is_best"].sum() == 1 and len(marked) == table.count() <= 8
    losses = [r["loss"] for r in table.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_stops_early_and_restores_weights(spark, rows, monkeypatch):
    scores, seen, run = iter([0, 5, 9, 9, 3, 2, 1, 8]), [], epochs._pass

    def scripted(table, weights, bias):
        seen.append((weights.copy(), bias))
        return run(table, weights, bias) | {epochs.HITS: (float(next(scores)), 10)}

    monkeypatch.setattr(epochs, "_pass", scripted)
    model, table = epochs.train_by_epochs(rows, "text", epochs=20, patience=3)
    assert [r["score"] for r in table.orderBy("epoch").collect()] == [0.5, 0.9, 0.9, 0.3, 0.2, 0.1]
    # Pass 0 is before the first epoch; the later of two equal epochs is the best.
    assert np.array_equal(model.weights, seen[3][0]) and model.bias == seen[3][1]


def test_gradient_equals_numpy(rows):
    idf = np.ones(1 << 16)
    used = rows.filter("split in ('train', 'val') and label is not null")
    table = epochs._hashed(used, "text", idf, "vector").selectExpr("double(label) AS label", "split = 'train' AS is_train", "vector")
    weights = np.random.default_rng(1).normal(size=len(idf))
    dense, y, train = [], [], []
    for r in table.collect():
        x = np.zeros(len(idf))
        x[r["vector"]["slots"]] = r["vector"]["values"]
        dense.append(x), y.append(r["label"]), train.append(r["is_train"])
    x, y, train = np.array(dense), np.array(y), np.array(train)
    z = x @ weights + 0.5
    want = ((1 / (1 + np.exp(-z)) - y) * train) @ x
    got = epochs._pass(table.repartition(5), weights, 0.5)
    assert np.allclose([got.get(s, (0.0, 0))[0] for s in range(len(idf))], want)
    assert got[epochs.HITS] == (float(((z > 0) == (y > 0))[~train].sum()), int((~train).sum()))


def test_no_rows(rows):
    model, table = epochs.train_by_epochs(rows.limit(0), "text")
    assert table.count() == 0
    assert {r["prediction"] for r in model.transform(rows).collect()} == {0.0}
    _, table = epochs.train_by_epochs(rows.filter("split = 'train'"), "text", patience=2)
    assert [r["score"] for r in table.collect()] == [None] * 3
