"""Hard negatives against Python integers, on edge rows, and against SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from threadlens.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, block int, anchor int, score double, rank int"


def _brute(rows, low=30, high=90):
    """Rows (id, vector, label) to result tuples, one anchor per hundredth id."""
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        usable.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    usable = [r for r in usable if sum(x * x for x in r[2]) <= 1 << 62]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if i % 100 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in usable if j != i))
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and low * -score <= 100 * -s[0] <= high * -score][:10]
            out += [(i, j, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(found)]
    return sorted(out)


def _run(spark, rows):
    df = spark.createDataFrame([(*r[:3], "x", 1, 2, 0.5, 3) for r in rows], SCHEMA)
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(df, F.col("id") % 100 == 0, label)


def test_sql_twin(spark):
    key = "op11_hard_negatives"
    assert compare(queries.QUERIES[key](spark, SF), connect(SF), queries.SQL[key]) is None


@pytest.mark.parametrize("magnitude", [1.0, 3e4, 2e6])
def test_residues_are_exact(magnitude):
    rng = np.random.default_rng(1)
    a, b = np.floor(256 * magnitude * rng.standard_normal((2, 40, 70)))
    norm = max((a * a).sum(1).max(), (b * b).sum(1).max())
    primes = hard_negatives.moduli(norm)
    got = hard_negatives.product(
        [hard_negatives.residues(a, p) for p in primes], [hard_negatives.residues(b, p) for p in primes], primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_edge_rows(spark):
    rng = random.Random(3)
    vectors = [[rng.choice((-0.5, 0.25, 0.5, 1.0)) for _ in range(6)] for _ in range(12)]
    rows = [(i, rng.choice(vectors), rng.choice((1, 2, 3, -10))) for i in range(320)]
    rows += [rows[5], rows[5], rows[100], (None, vectors[0], 1), (400, None, 1), (401, vectors[0], None), (500, [None, 1.0], 1)]
    rows += [(600, [float("nan")], 1), (601, [float("inf")], 1), (700, [], 1), (800, [1.0, 1.0], 1), (900, [3e38] * 6, 2)]
    got = sorted(tuple(r) for r in _run(spark, rows).collect())
    assert got == _brute(rows) and len(got) > 100


def test_large_scores(spark):
    rng = random.Random(4)
    rows = [(i * 10, [rng.uniform(-1, 3) * 1e6 for _ in range(5)], i % 3) for i in range(60)]
    got = sorted(tuple(r) for r in _run(spark, rows).collect())
    assert got == _brute(rows) and max(abs(r[4]) for r in got) > 1 << 53


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 60)
    monkeypatch.setattr(hard_negatives, "CELL_SCORES", 40)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(4)], i % 4) for i in range(450)]
    assert sorted(tuple(r) for r in _run(spark, rows).collect()) == _brute(rows)


def test_no_rows(spark):
    assert _run(spark, []).count() == 0
    assert _run(spark, [(100, [1.0], 1)]).count() == 0
