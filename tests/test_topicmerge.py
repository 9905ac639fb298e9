"""Merging of topics against all pairs, and density topics end to end."""

import math

import numpy as np
import pytest

from threadlens.operators import topicmerge


def brute_units(counts):
    total, overall = {}, {}
    for t, w, n in counts:
        total[t] = total.get(t, 0) + n
        overall[w] = overall.get(w, 0) + n
    mean = sum(total.values()) / len(total)
    out = {t: {} for t in total}
    for t, w, n in counts:
        out[t][w] = n / total[t] * math.log(1 + mean / overall[w])
    for v in out.values():
        length = math.sqrt(sum(x * x for x in v.values()))
        for w in v:
            v[w] /= length
    return out


def brute_pairs(counts, at):
    u = brute_units(counts)
    cos = {(a, b): round(sum(x * u[b].get(w, 0) for w, x in u[a].items()), 9) for a in u for b in u if a < b}
    return {p: c for p, c in cos.items() if c >= at}


def brute_merge(counts, at):
    names = {t: t for t, _, _ in counts}
    while pairs := brute_pairs(counts, at):
        label = {t: t for t, _, _ in counts}
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = {t: low if x == high else x for t, x in label.items()}
        names = {t: label[x] for t, x in names.items()}
        added = {}
        for t, w, n in counts:
            added[label[t], w] = added.get((label[t], w), 0) + n
        counts = [(t, w, n) for (t, w), n in added.items()]
    return names


def table(spark, counts):
    return spark.createDataFrame(counts, "topic_id long, term string, n long")


def random_counts(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 12, size=(5, 40))
    out = []
    for t in range(18):
        row = np.maximum(base[t % 5] + rng.integers(-3, 4, size=40) * (1 + t % 3), 0)
        row[0] = 50  # a word that every topic uses
        out += [(t, f"w{i}", int(n)) for i, n in enumerate(row) if n]
    return out


@pytest.mark.parametrize("at", [0.6, 0.9, 1.0])
def test_pairs_equal_all_pairs(spark, at):
    counts = random_counts(1) + [(40, "w1", 3), (41, "w1", 9), (50, "alone", 1)]
    got = {(r["a"], r["b"]): r["cosine"] for r in topicmerge.similar_topics(table(spark, counts), at).collect()}
    want = brute_pairs(counts, at)
    assert want and got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-8) for p in want)


def test_common_words_lead_nowhere(spark):
    """Topics that share only what all share are not even compared."""
    counts = [(t, "the", 5) for t in range(6)] + [(t, f"own{t}", 60) for t in range(6)]
    units = topicmerge.unit_terms(table(spark, counts))
    assert {r["term"] for r in topicmerge.leading_terms(units, 0.9).collect()} == {f"own{t}" for t in range(6)}


def test_merging_goes_on_until_nothing_is_alike(spark):
    counts = random_counts(3)
    got = {r["topic_id"]: r["merged"] for r in topicmerge.merge_topics(table(spark, counts), 0.78).collect()}
    want = brute_merge(counts, 0.78)
    once = {r["topic_id"]: r["merged"] for r in topicmerge.merge_topics(table(spark, counts), 0.78, rounds=1).collect()}
    assert got == want and 1 < len(set(want.values())) < len(set(once.values())) < 18
    empty = table(spark, [])
    assert topicmerge.merge_topics(empty, 0.9).count() == 0


def test_density_topics(spark):
    """Three dense groups, two of which use the same words: two topics, whatever their number was meant to be."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        v = np.eye(4)[i % 3] + rng.normal(size=4) * 0.05
        word = ["apple pear fruit", "engine wheel car", "engine wheel car"][i % 3]
        rows.append((i, word, [float(x) for x in v]))
    rows.append((90, "apple", [0.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    out = {r["id"]: r["topic_id"] for r in topicmerge.density_topics(df, "text", min_points=4, min_topic_size=8).collect()}
    assert len(out) == 91 and out[90] == -1
    fruit = {out[i] for i in range(0, 90, 3)} - {-1}
    cars = {out[i] for i in range(90) if i % 3} - {-1}
    assert len(fruit) == len(cars) == 1 and fruit != cars


def test_terms_of_one_topic_are_length_only(spark):
    counts = random_counts(7) + [(t, f"only{t}", 9 + t) for t in range(18)]
    units = topicmerge.unit_terms(table(spark, counts)).cache()
    alone = units.filter("topics = 1").selectExpr("topic_id", "u * u AS alone")
    whole = {(r[0], r[1]) for r in topicmerge.leading_terms(units, 0.6).collect()}
    shared = {(r[0], r[1]) for r in topicmerge.leading_terms(units.filter("topics > 1"), 0.6, alone=alone).collect()}
    assert shared == {x for x in whole if not x[1].startswith("only")} and len(shared) < len(whole)


@pytest.mark.parametrize("counts", [
    random_counts(8),
    [(t, "common", 3) for t in range(40)] + [(t, f"pair{t // 2}", 5) for t in range(40)] + [(t, f"own{t}", 1) for t in range(40)],
])
def test_either_way_of_meeting_equals_all_pairs(spark, counts):
    """Dense counts meet at their terms; topics that share few rare words are looked up pair by pair."""
    got = {(r["a"], r["b"]): r["cosine"] for r in topicmerge.similar_topics(table(spark, counts), 0.5).collect()}
    want = brute_pairs(counts, 0.5)
    assert want and set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=2e-9) for p in want)
