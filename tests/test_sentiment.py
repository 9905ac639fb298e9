"""Rules of sentiment on plain sentences."""

import math

import pytest

from threadlens.functions.sentiment import add_rule_sentiment


def _c(s):
    return s / math.sqrt(s * s + 15)


@pytest.mark.parametrize("text, total, negated, boosted", [
    ("this is good", 1.9, 0, 0), ("this is not good", -0.74 * 1.9, 1, 0), ("not so very good", -0.74 * (1.9 + 0.293 + 0.293 * 0.95), 1, 1),
    ("a slightly bad day", -(2.5 - 0.293), 0, 1), ("not one of these was good", 1.9, 0, 0), ("this is GOOD", 1.9 + 0.733, 0, 0),
    ("THIS IS GOOD", 1.9, 0, 0), ("good but bad", 0.5 * 1.9 - 1.5 * 2.5, 0, 0), ("good!! fine!", 1.9 + 3 * 0.292, 0, 0),
    ("bad!!!!!!!", -2.5 - 4 * 0.292, 0, 0), ("never mind, it isn't bad", 0.74 * 2.5, 1, 0), ("nothing here!", 0, 0, 0), ("", 0, 0, 0),
    (None, 0, 0, 0), ("very", 0, 0, 0),
])
def test_rules(spark, text, total, negated, boosted):
    row = add_rule_sentiment(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["sentiment_compound"] == pytest.approx(_c(total)) and (row["n_negated"], row["n_boosted"]) == (negated, boosted)


def test_empty_table_and_lexicons(spark):
    df = spark.createDataFrame([("good not good",)], "t string")
    assert add_rule_sentiment(df.limit(0), "t").count() == 0
    got = add_rule_sentiment(df, "t", {}, {}, [], []).first()
    assert (got["sentiment_compound"], got["n_negated"]) == (0.0, 0)
