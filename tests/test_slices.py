"""Batches of token lists in slices."""

import pyarrow as pa
import pytest

from threadlens.operators import epochs, modelfeat


def test_batches_are_cut_by_tokens():
    lists = pa.array([[1] * 5, [], [2] * 3, [3] * 9, [4], [], []], pa.list_(pa.int32()))
    parts = [p.to_pylist() for p in modelfeat.token_slices(lists, 8)]
    assert [len(p) for p in parts] == [3, 1, 3] and sum(parts, []) == lists.to_pylist()
    assert [len(p) for p in modelfeat.token_slices(lists.slice(0, 0), 8)] == [0]


def test_vectors_do_not_depend_on_slices(spark, monkeypatch):
    df = spark.createDataFrame([(f"w{i} x " * (i % 7),) for i in range(40)] + [(None,)], "text string").coalesce(1)
    weights = modelfeat.slot_weights(df, "text")

    def both():
        dense = modelfeat.embed_texts(df, "text", dim=16, weights=weights).select("embedding").collect()
        sparse = epochs._hashed(df, "text", weights, "v").select("v").collect()
        return dense, sparse

    whole = both()
    cutter = modelfeat.token_slices
    for module in (modelfeat, epochs):
        monkeypatch.setattr(module, "token_slices", lambda lists: (x for x in cutter(lists, 4)))
    assert both() == whole


def test_chunks_are_hashed_once(spark):
    rows = [(1, "a b c d e a"), (2, "x"), (2, "x"), (3, ""), (4, None), (None, "a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    long = modelfeat.embed_long_text(df, "text", limit=3, size=2, dim=8)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "split(" not in plan
    chunks = modelfeat.text_chunks(df, "text", limit=3, size=2)
    twice = modelfeat.embed_long_text(df, "text", limit=3, size=2, dim=8, weights=modelfeat.slot_weights(chunks, "chunk"))
    assert {r["id"]: r["embedding"] for r in long.collect()} == {r["id"]: pytest.approx(r["embedding"]) for r in twice.collect()}
