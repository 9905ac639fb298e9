"""Every registered query with a SQL twin must agree with it; the others must return rows."""

import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from threadlens.plans.registry import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(k for k, q in load().items() if q.sql is not None))
def test_matches_sql(spark, con, key):
    q = load()[key]
    assert compare(q.run(spark, SF), con, q.sql) in (None, "no rows on either side")


# Iterative fits on a table this small take long for what they show; the learning tests cover them.
SLOW = {"kmeans_clusters_3d", "fit_text_classifier", "score_batch", "fit_topics", "feature_matrix"}


@pytest.mark.parametrize("key", sorted(k for k, q in load().items() if q.sql is None and k not in SLOW))
def test_runs(spark, key):
    assert load()[key].run(spark, SF).count() > 0


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_parts(monkeypatch):
    whole = set(entry.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("threadlens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "threadlens.llm", None)
    assert set(entry.queries()) == set(load()) < whole
    assert set(entry.oracle_sql()) <= set(load())
