"""Edge texts that the tables do not contain, checked against plain Python."""

import datetime
import re
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import scalars, text
from threadlens.operators import modelfeat, project, textfeat

EDGES = [
    None, "", "http://only.example/x", "  \n ", "a b c", "a \U0001F600 b \U0001F600", "....",
    "[Removed] x", "[removed]", "abcd", "abcde", "don't stop. I'm here!\n\nYes?  ok\tok www.x.y end",
    "I think overall it seems fine. I think so!", "one", "one two", "a b c a b c a b c d",
    "été Été made the same cake.", "Wait... what?! Really... no.", "　x　",
]


def clean(t):
    if t is None:
        return ""
    return re.sub(r"[ \t]+", " ", re.sub(r"http\S+|www\.\S+", "", t)).strip()


def repetition(t, n):
    w = t.lower().split()
    grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return sum(c > 1 for c in grams.values()) / len(grams) if grams else 0.0


def richness(t):
    freq = Counter(w.lower() for w in t.split() if w.isalpha())
    n = sum(freq.values())
    return (len(freq) / n, sum(c == 1 for c in freq.values()) / n) if n else (0.0, 0.0)


def expected(t):
    w = t.split()
    low = t.lower().split()
    ttr, hapax = richness(t)
    return {
        "char_count": len(t), "word_count": len(w),
        "avg_word_length": sum(map(len, w)) / len(w) if w else 0.0,
        "paragraph_count": sum(1 for p in t.split("\n") if p.strip()),
        "ttr": ttr, "hapax_ratio": hapax,
        "stopword_ratio": sum(x in set(lx.STOPWORDS) for x in low) / len(low) if low else 0.0,
        "punctuation_density": sum(c in string.punctuation for c in t) / len(t) if t else 0.0,
        "exclamation_count": t.count("!"), "question_count": t.count("?"),
        "ellipsis_count": t.count("..."), "emoji_count": sum(ord(c) > 0xFFFF for c in t),
        "trigram_repeat_rate": repetition(t, 3), "fourgram_repeat_rate": repetition(t, 4),
        "hedging_per_100w": sum(t.lower().count(p) for p in lx.HEDGING_PHRASES) / len(w) * 100 if w else 0.0,
        "self_reference_rate": sum(x in lx.FIRST_PERSON for x in low) / len(low) if low else 0.0,
    }


def features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    df = df.withColumn("text_clean", text.clean_text(F.col("text")))
    return textfeat.add_features(df, "text_clean").orderBy("id").collect()


def test_features_on_edge_texts(spark):
    for raw, row in zip(EDGES, features(spark, EDGES)):
        assert row["text_clean"] == clean(raw)
        for name, value in expected(clean(raw)).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (raw, name)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcdeABé .!?\n\t'- http:/w", max_size=60), min_size=20, max_size=40))
def test_features_on_random_texts(spark, texts):
    for raw, row in zip(texts, features(spark, texts)):
        assert row["text_clean"] == clean(raw)
        for name, value in expected(clean(raw)).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (raw, name)


def test_sentence_features(spark):
    rows = features(spark, ["One two. Three four five! Six", "only one sentence", ""])
    assert [r["sentence_count"] for r in rows] == [3, 1, 0]
    assert rows[0]["sentence_length_std"] == pytest.approx((2 / 3) ** 0.5)
    assert rows[0]["burstiness"] == pytest.approx((2 / 3) ** 0.5 / 2)
    assert rows[1]["burstiness"] == rows[1]["sentence_length_std"] == 0.0


def test_syllables(spark):
    df = spark.createDataFrame([("the made, banana rhythm queue 12",)], "t string")
    assert df.select(text.syllable_counts(F.col("t"))).first()[0] == [1, 1, 3, 1, 1, 1]


def test_clean_filters(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "id long, text string")
    kept = {r["id"] for r in project.filter_clean_posts(df, "text").collect()}
    want = {
        i for i, t in enumerate(EDGES)
        if t and t.strip() and "[removed]" not in t.lower() and "[deleted]" not in t.lower()
    }
    assert kept == want
    exact = {r["id"] for r in project.filter_invalid_markers_exact(df, "text").collect()}
    assert exact == {i for i, t in enumerate(EDGES) if t is not None and t not in lx.INVALID_MARKERS}
    long = {r["id"] for r in project.filter_min_length(df, "text").collect()}
    assert long == {i for i, t in enumerate(EDGES) if t is not None and len(t) >= 5}
    flags = [r["is_removed_deleted"] for r in project.flag_removed(df, "text").orderBy("id").collect()]
    assert flags == [bool(t) and "[removed]" in t.lower() for t in EDGES]


def test_mixed_timestamps(spark):
    raw = ["1700000000", "1700000000000", "1000000000000", "2024-01-02T03:04:05Z",
           "2024-01-02T03:04:05.123456+02:00", "xx", None, "NaN"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    got = [r[0] for r in df.orderBy("id").select(scalars.parse_mixed_timestamp(F.col("raw"))).collect()]
    utc = datetime.datetime
    assert got[0] == got[1] == utc(2023, 11, 14, 22, 13, 20)
    assert got[2] is None
    assert got[3] == utc(2024, 1, 2, 3, 4, 5)
    assert got[4] == utc(2024, 1, 2, 1, 4, 5, 123456)
    assert got[5:] == [None, None, None]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(["3", "x", None, "NaN", "-2.5"])], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(scalars.coerce_numeric(F.col("r"))).collect()]
    assert got == [3.0, 0.0, 0.0, 0.0, -2.5]


def test_compose_and_prefix(spark):
    df = spark.createDataFrame([(None, "b", "t3_a"), ("a", None, "t1_b"), (None, None, None), ("x", "y", "at3_b")],
                               "a string, b string, p string")
    rows = df.select(text.compose_text(F.col("a"), F.col("b"), "|"), text.strip_id_prefix(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["|b", "a|", "|", "x|y"]
    assert [r[1] for r in rows] == ["a", "b", None, "at3_b"]


def test_model_features_on_empty_and_short_texts(spark):
    df = spark.createDataFrame([(1, "", "train"), (2, "word", "train"), (3, "the cat the cat", "train"),
                                (4, "new words here", "val")], "id long, t string, split string")
    ppl = {r["id"]: r["perplexity"] for r in modelfeat.corpus_perplexity(df, "t").collect()}
    assert ppl[1] is None and ppl[2] is None and ppl[3] < ppl[4]
    pos = {r["id"]: r for r in modelfeat.pos_distribution(df, "t").collect()}
    assert pos[1]["formality_score"] == 0.5 and pos[1]["pos_NN"] == 0.0
    assert pos[3]["pos_DT"] == 0.5
    sent = {r["id"]: r for r in modelfeat.sentiment_scores(
        df.union(spark.createDataFrame([(5, "good day. bad day", "val")], df.schema)), "t").collect()}
    assert sent[1]["sentiment_compound"] == 0.0 and sent[1]["sentiment_neu"] == 0.0
    assert sent[5]["sentiment_variability"] > 0 and sent[5]["sentiment_pos"] < sent[5]["sentiment_neg"]


def test_encoding_shape(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "z " * 400)], "id long, t string")
    vocab = modelfeat.build_vocabulary(df.filter("id = 1"), "t", 6)
    enc = {r["id"]: r for r in modelfeat.encode_tokens(df, "t", vocab).collect()}
    assert enc[1]["input_ids"][:7] == [2, 4, 5, 4, 1, 3, 0]
    assert enc[2]["input_ids"][:3] == [2, 3, 0] and sum(enc[2]["attention_mask"]) == 2
    assert all(len(r["input_ids"]) == 256 == len(r["attention_mask"]) for r in enc.values())
    assert sum(enc[3]["attention_mask"]) == 256 and enc[3]["input_ids"][-1] == 3


def test_embeddings_are_unit_vectors_and_hook_is_used(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "a b c"), (4, None)], "id long, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in modelfeat.embed_texts(df, "t", dim=16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert (got[1] == got[3]).all() and not got[2].any() and not got[4].any()

    def factory():
        return lambda texts: np.array([[3.0, 4.0 * len(t)] for t in texts])

    hooked = {r["id"]: r["embedding"] for r in modelfeat.embed_texts(df, "t", encoder=factory).collect()}
    assert hooked[2] == [1.0, 0.0]
    long = modelfeat.embed_long_text(df.filter("id = 1"), "t", limit=2, size=1, encoder=factory).collect()
    assert long[0]["embedding"] == pytest.approx([0.6, 0.8])
