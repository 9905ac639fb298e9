"""Learned sentence borders."""

import random

import pytest

from threadlens.operators import borders

SCHEMA = "id bigint, text string, k string, b string"
WORDS = "river along today house people walked good near old many garden".split()


def _sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(8))


@pytest.fixture(scope="module")
def abbreviations(spark):
    rng = random.Random(3)
    rows = [f"{_sentence(rng)}. Dr. Smith {_sentence(rng)} e.g. {_sentence(rng)}. {_sentence(rng)}!" for _ in range(80)]
    return borders.abbreviation_types(spark.createDataFrame([(t,) for t in rows], "text string"), "text")


def test_types_are_learned(abbreviations):
    found = {r["word_type"] for r in abbreviations.collect()}
    assert found == {"dr", "e.g"}


def test_borders(spark, abbreviations):
    rows = [
        (1, "Dr. Smith came. He left."), (2, None), (3, ""), (4, "  "), (5, "Dr."), (6, "one two"), (6, "one two"),
        (None, "What?! Yes... E.g. this."), (7, "(Dr. Who) ran. ok"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    split = borders.sentence_borders(docs, "text", abbreviations)
    assert split.columns == [*docs.columns, "sentence_words", "n_abbreviations"] and split.count() == len(rows)
    got = {r["text"]: (r["sentence_words"], r["n_abbreviations"]) for r in split.collect()}
    assert got["Dr. Smith came. He left."] == ([3, 2], 1) and got["Dr."] == ([1], 0) and got["one two"] == ([2], 0)
    assert got[None] == got[""] == got["  "] == ([], 0)
    assert got["What?! Yes... E.g. this."] == ([1, 1, 2], 1) and got["(Dr. Who) ran. ok"] == ([3, 1], 1)


def test_empty_corpus(spark, abbreviations):
    empty = spark.createDataFrame([], SCHEMA)
    none = borders.abbreviation_types(empty, "text")
    assert none.count() == 0 and borders.sentence_borders(empty, "text", none).count() == 0
    one = spark.createDataFrame([(1, "Dr. Smith came.", "x", "y")], SCHEMA)
    assert one.count() == 1 and borders.sentence_borders(one, "text", none).first()["sentence_words"] == [1, 2]


def test_words_are_read_once_for_the_types(spark):
    docs = spark.createDataFrame([(1, "He came. Dr. Smith came.", "x", "y")], SCHEMA)
    plan = borders.abbreviation_types(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "scalar-subquery" in plan
