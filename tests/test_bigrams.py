"""Scores of word pairs against brute force."""

import math
from collections import Counter

import pytest

from threadlens.operators import modelfeat


def test_perplexity_of_kept_and_new_pairs(spark):
    train = ["the dog ran home", "the dog slept", "a dog", "alone", "the the the the"]
    rows = [(1, "the dog ran"), (2, "the cat ran the dog"), (3, "new words here"), (4, "alone"), (5, ""), (6, None), (None, "the dog"),
            (7, "the dog " * 50), (7, "a new")]
    model = modelfeat.fit_bigrams(spark.createDataFrame([(t,) for t in train], "text string"), "text")
    scored = modelfeat.score_bigrams(spark.createDataFrame(rows, "id long, text string"), "text", model)
    pairs = Counter(p for t in train for p in zip(t.split(), t.split()[1:]))
    first = Counter(p for (p, _), n in pairs.items() for _ in range(n))
    size = len({w for t in train for w in t.split()})
    logs = {}
    for i, t in rows:
        for a, b in zip((t or "").split(), (t or "").split()[1:]):
            logs.setdefault(i, []).append(math.log((pairs[a, b] + 0.1) / (first[a] + 0.1 * size)))
    got = {r["id"]: r["perplexity"] for r in scored.collect()}
    assert got == pytest.approx({i: math.exp(-sum(x) / len(x)) for i, x in logs.items()})
    # Pairs of the texts pass one join; their different pairs are no table of their own.
    assert "Aggregate [a#" not in "".join(
        x for x in scored._jdf.queryExecution().optimizedPlan().toString().splitlines(True) if "b#" in x.split("]")[0])


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_perplexity_whatever_is_broadcast(spark, monkeypatch, most):
    train = ["the dog ran home", "the dog slept", "a dog", "alone", "the the the the", "the dog ran off"]
    texts = ["the dog ran", "the cat ran the dog", "new words here", "the the dog", "a dog"]
    monkeypatch.setattr(modelfeat, "BROADCAST_ROWS", most)
    model = modelfeat.fit_bigrams(spark.createDataFrame([(t,) for t in train], "text string"), "text")
    scored = modelfeat.score_bigrams(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", model)
    pairs = Counter(p for t in train for p in zip(t.split(), t.split()[1:]))
    first = Counter(p for (p, _), n in pairs.items() for _ in range(n))
    size = len({w for t in train for w in t.split()})
    want = {}
    for i, t in enumerate(texts):
        logs = [math.log((pairs[a, b] + 0.1) / (first[a] + 0.1 * size)) for a, b in zip(t.split(), t.split()[1:])]
        want[i] = math.exp(-sum(logs) / len(logs))
    assert {r["id"]: r["perplexity"] for r in scored.collect()} == pytest.approx(want)
    # Frequent pairs and words are summed before any shuffle, and new pairs take no second one.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == (most < 1000) and "LeftOuter" in plan


def test_perplexity_without_smoothing(spark):
    """Pairs that were not kept do not count."""
    model = modelfeat.fit_bigrams(spark.createDataFrame([("a b a c",)], "text string"), "text", k=0.0)
    scored = modelfeat.score_bigrams(spark.createDataFrame([(1, "a b x"), (3, "b a b")], "id long, text string"), "text", model)
    assert {r["id"]: r["perplexity"] for r in scored.collect()} == pytest.approx({1: 2.0, 3: math.sqrt(2.0)})
