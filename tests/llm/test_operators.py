"""Operators of the training-data subpackage on edge frames, against brute force, and against SQL."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare, connect
from threadlens.llm import bpe, exact_dedup, fingerprints, langid, lm_score, mixing, near_dedup, quality, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n bigint, keep_id string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def _prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and clashing column names."""
    base = _prose(120, 1)
    texts = [
        None, "", " ", "one", base, base, base.replace(" ", "  \n"), base + " tail", _prose(30_000, 2), "été " * 50,
        "a" * 5000, "\n\n\n", "tied text", "tied text", "12 34 !!", _prose(80, 3) + base,
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, i, i, "k", "m") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("key", ["op1_mixing", "op3_exact_dedup", "op5_lm_score"])
def test_sql_twins(spark, key):
    assert compare(queries.QUERIES[key](spark, SF), connect(SF), queries.SQL[key]) is None


def test_exact_groups(edge, empty):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(edge).collect()}
    text = {r["doc_id"]: r["text"] for r in edge.filter("doc_id IS NOT NULL").collect()}
    same = got[5, hashlib.sha256(text[4].encode()).hexdigest()]
    assert (same["keep_id"], same["group_size"], same["kept"]) == (4, 6, False)
    assert len(got) == edge.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_exact_copies(edge, empty):
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and exact_dedup.drop_exact_copies(empty).count() == 0
    normal = exact_dedup.collapse_spaces(F.col("text"))
    assert kept.count() == edge.select(normal.alias("t")).distinct().count()
    assert kept.filter("doc_id IN (0, 4, 12)").count() == 3


def test_mixing(spark, edge, empty):
    mixed = mixing.mix(edge, block_rows=1)
    assert mixed.count() == edge.count() and mixing.mix(empty).count() == 0
    assert mixed.select("mix_order").distinct().count() == edge.count()
    assert mixed.filter("slot < release_slot OR slot >= deadline_slot").count() == 0
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    weights = spark.createDataFrame([("a", 1), ("b", 3)], "source string, weight bigint")
    order = [r["source"] for r in mixing.in_mix_order(mixing.mix(rows, weights=weights, block_rows=10)).collect()]
    for n in range(10, 1000, 10):  # both sources last that long
        assert abs(order[:n].count("b") - 0.75 * n) < 10
    partly = mixing.mix(rows, weights=weights.filter("source = 'b'"), block_rows=10)
    assert partly.count() == 4000


def test_mixing_in_levels(spark):
    """Sources below one tick are mixed to their weights as well, and weights need not be whole."""
    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"))
    names = [r["source"] for r in mixing.in_mix_order(mixing.mix(rows, block_rows=1)).collect()]
    assert len(names) == 12000
    for n in range(3000, 12000, 3000):  # equal weights: every source has its share at any time, up to its levels
        assert all(abs(names[:n].count(f"s{i}") - n / 3000) < 3 for i in range(0, 3000, 97))
    assert len(set(names[:3000])) > 2700
    pair = rows.withColumn("source", F.when(F.col("doc_id") < 6000, "big").when(F.col("doc_id") < 8000, "p").otherwise("q"))
    weights = spark.createDataFrame([("big", 100000), ("p", 10), ("q", 40)], "source string, weight bigint")
    pool = [r["source"] for r in mixing.in_mix_order(mixing.mix(pair, weights=weights, block_rows=1)).collect()]
    pool = [x for x in pool if x != "big"]
    for n in range(1, 4000):
        assert abs(pool[:n].count("p") - 0.2 * n) < 1
    part = spark.createDataFrame([("big", 0.25), ("p", 0.25), ("q", 0.5)], "source string, weight double")
    order = [r["source"] for r in mixing.in_mix_order(mixing.mix(pair, weights=part, block_rows=1)).collect()]
    for n in range(1, 4000):
        assert abs(order[:n].count("q") - 0.5 * n) < 1 and abs(order[:n].count("p") - 0.25 * n) < 1


def test_fingerprints(edge, empty):
    docs = edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = fingerprints.compare_with_edits(docs).orderBy("doc_id").toPandas()
    text = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    for i, t in enumerate(text):
        after = text[(i + 1) % len(text)]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        bag, other = Counter(t.split()), Counter(edited.split())
        if len(t) > 300:
            assert abs(got.near_edited[i] - (bag & other).total() / (bag | other).total()) < 0.3
    assert got.fingerprint[4] == got.fingerprint[5] and got.near_next[4] == 1.0
    assert fingerprints.compare_with_edits(edge).count() == edge.count()
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_quality(spark, edge, empty):
    labels = spark.createDataFrame([(i, int(i not in (3, 10, 14))) for i in range(16)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.fit(edge, labels)
    scores = edge.select(quality.score(edge, model).alias("s")).toPandas().s
    assert len(scores) == edge.count() and scores.between(0, 1).all()
    assert quality.score and set(edge.select(quality.score(edge, quality.fit(empty, labels)).alias("s")).toPandas().s) == {0.5}
    # Forward-backward against all labellings of a short chain.
    odds, moves = np.array([0.4, -1.1, 0.3]), np.array([[2.0, 0.5], [0.7, 1.5]])
    total, good = 0.0, np.zeros(3)
    for code in range(8):
        y = [(code >> i) & 1 for i in range(3)]
        p = np.exp(sum(o for o, v in zip(odds, y) if v)) * moves[y[0], y[1]] * moves[y[1], y[2]]
        total += p
        good += p * np.array(y)
    assert np.allclose(quality.Chain(np.array([3])).marginals(odds, moves)[0], good / total)


def test_language(spark, edge, empty):
    got = queries.op6_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = langid.fit(edge)
    found = edge.select("text", langid.identify(edge, model)["lang"].alias("lang")).collect()
    assert all((r["lang"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in found)
    assert {r["l"] for r in edge.select(langid.identify(edge, langid.fit(empty))["lang"].alias("l")).collect()} == {"und"}
    # The code lengths of all bytes after a context never exceed a probability of one.
    assert np.exp2(-model.cost[:, 0].reshape(-1, langid.SYMBOLS)[:, :langid.PAD]).sum(axis=1).max() <= 1 + 1e-6


def test_language_code_lengths_are_exact(spark):
    """Several scripts, more byte values and contexts than any table of fixed size; some texts begin with zero bytes."""
    rng = random.Random(5)
    wide = lambda n: "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 2047), rng.randint(2048, 40000)])) for _ in range(n))
    train = [(i, wide(9000), f"l{i % 3}") for i in range(6)] + [(6, "\0\0ab", "l0"), (7, "rare", "l3")]
    model = langid.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert model.langs == ["l0", "l1", "l2", "l3"]
    counts = {}
    for _, text, lang in train:
        b = [-1, -1, -1, *text.encode()]
        for i in range(3, len(b)):
            for size in range(4):
                counts.setdefault((lang, *b[i - size:i]), Counter())[b[i]] += 1

    def bits(text, lang):
        b, total = [-1, -1, -1, *text.encode()], 0.0
        for i in range(3, len(b)):
            p = 1.0
            for size in (3, 2, 1, 0, None):
                if size is None:
                    p /= 256
                elif seen := counts.get((lang, *b[i - size:i])):
                    p *= (seen[b[i]] or len(seen)) / (seen.total() + len(seen))
                    if seen[b[i]]:
                        break
            total -= np.log2(p)
        return total

    texts = ["", "\0x", *[t[100:400] for _, t, _ in train[:3]], wide(200), "rare"]
    import pyarrow as pa
    want = [[bits(t, lang) for lang in model.langs] for t in texts]
    assert np.allclose(model.bits(pa.array(texts)), want, rtol=1e-4)
    assert model.predict(pa.array(texts))[0][-1] == "l3"


def test_suffix_dedup(edge, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in edge.collect()]
    seen = Counter(b[p:p + 200] for _, b in rows for p in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        want.append((str(i), bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = suffix_dedup.remove_repeats(edge).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_longest_previous_factors():
    text = "abaababaabaab"
    data = np.array([ord(c) for c in text])
    length, source = suffix_dedup.longest_previous_factors(*suffix_dedup.suffix_order(data, len(text)))
    match = lambda i, j: next((k for k in range(len(text) - j) if text[i + k] != text[j + k]), len(text) - j)
    for j in range(len(text)):
        assert length[j] == max((match(i, j) for i in range(j)), default=0)
        assert length[j] == 0 or match(source[j], j) == length[j]


def test_factors_inside_runs_only(monkeypatch):
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 256, 230, dtype=np.uint8).tobytes()
    spans = [rng.integers(0, 256, 368, dtype=np.uint8).tobytes() for _ in range(20)] + [b"x" * 30 + shared, shared + b"y" * 60, b"z" * 250]
    seen = Counter(s[p:p + 200] for s in spans for p in range(len(s) - 199))
    sizes, factors = [], suffix_dedup.longest_previous_factors
    monkeypatch.setattr(suffix_dedup, "longest_previous_factors", lambda order, lcp: sizes.append(len(order)) or factors(order, lcp))
    got = suffix_dedup.repeated_windows(spans)
    assert [x.tolist() for x in got] == [[p for p in range(len(s) - 199) if seen[s[p:p + 200]] > 1] for s in spans]
    assert sizes == [sum(n for n in seen.values() if n > 1)]
    assert [len(x) for x in suffix_dedup.repeated_windows(spans[:20])] == [0] * 20


def test_window_hash_route(edge, monkeypatch):
    want = {(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(edge).collect()}
    monkeypatch.setattr(suffix_dedup, "ARRAY_SPANS", 1)
    assert {(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(edge).collect()} == want


def test_near_classes(spark, edge, empty):
    base = _prose(200, 9).split()
    rows = [(i, " ".join([*base[:i * 5], f"x{i}", *base[i * 5:]])) for i in range(30)] + [(100 + i, _prose(200, 50 + i)) for i in range(30)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas().set_index("doc_id")
    assert (got.class_id[:30] == 0).all() if got.index.is_monotonic_increasing else (got.class_id[got.index < 30] == 0).all()
    assert (got.class_id[got.index >= 100] == got.index[got.index >= 100]).all()
    classes = near_dedup.near_classes(edge)
    assert classes.count() == edge.count() and near_dedup.near_classes(empty).count() == 0
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id IN (5, 6, 7)").count() == 0
    assert kept.filter("doc_id IN (0, 3, 4, 8, 15)").select("doc_id").distinct().count() == 5


def test_near_classes_move_candidates_only(spark, monkeypatch):
    base, moved, links = _prose(200, 9).split(), [], near_dedup.links
    rows = [(i, " ".join([*base[:i * 5], f"x{i}", *base[i * 5:]])) for i in range(10)] + [(100 + i, _prose(200, 50 + i)) for i in range(90)]
    monkeypatch.setattr(near_dedup, "links", lambda texts, members: moved.append((texts.count(), members.count())) or links(texts, members))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 100} == {0} and len({r["class_id"] for r in got}) == 91
    assert moved[0][0] < 50 and moved[0][1] < 30 * near_dedup.BANDS


def test_near_classes_links_beside_the_centre(spark, monkeypatch):
    """Texts that link with one member of a large family only, and never with the centre of a band."""
    base = _prose(200, 9).split()

    def changed(words, places, mark):
        return [f"{mark}{i}" if i in places else w for i, w in enumerate(words)]

    family = [changed(base, {3 + i}, f"f{i}") for i in range(60)]
    v = changed(base, {70, 80, 90}, "v")
    beside = [changed(v, {100 + i, 120 + i, 140 + i, 160 + i}, f"x{i}") for i in range(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*family, v, *beside])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(near_dedup.similarity(near_dedup.Text(rows[-1][1]), near_dedup.Text(t)) >= 0.8 for _, t in rows[:60])
    for most in (500, 7):  # one block a band, and many
        monkeypatch.setattr(near_dedup, "TASK_MEMBERS", most)
        assert {r["class_id"] for r in near_dedup.near_classes(docs).collect()} == {0}


def test_near_classes_of_a_crowded_band_take_few_rounds(spark, monkeypatch):
    """Texts that share a passage, and so bands, but are no copies of each other: a round of centres settles hardly any of them."""
    passage, made, materialize = _prose(150, 9), [], near_dedup.materialize
    rows = [(i, f"{_prose(60, 100 + i)} {passage} {_prose(60, 200 + i)}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, rows[7][1] + " end")], "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    monkeypatch.setattr(near_dedup, "TASK_MEMBERS", 7)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: i for i in range(60)} | {60: 7}
    assert 0 < made.count("stars") < 5
    made.clear()
    monkeypatch.setattr(near_dedup, "TASK_MEMBERS", 500)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()} == got
    assert "stars" not in made and "across" not in made  # bands that fit a task are settled at once


def test_near_copies_of_one_family_are_aligned_once(monkeypatch):
    base, pairs, aligned = _prose(200, 9).split(), [], near_dedup._aligned
    texts = [" ".join([*base[:i * 5], f"x{i}", *base[i * 5:]]) for i in range(30)]
    monkeypatch.setattr(near_dedup, "_aligned", lambda x, y: pairs.append(1) or aligned(x, y))
    batches = [pa.RecordBatch.from_pylist([
        {"centre": c, "one": 0, "all": 0, "own": 1, "want": 1, "label": i, "text": t} for i, t in enumerate(texts)]) for c in range(24)]
    links = [(r["a"], r["b"]) for b in near_dedup._links_in_cells(iter(batches)) for r in b.to_pylist()]
    assert len(links) == len(pairs) == 29 and len({x for link in links for x in link}) == 30


def test_bands_and_runs_are_those_of_the_plain_form():
    """Values of the first form of the band hashes, and runs without pruned diagonals."""
    words = pd.util.hash_array(np.array(_prose(40, 3).split(), dtype=object), categorize=False)
    h = near_dedup._mix((near_dedup._shingles(words)[:, None] ^ near_dedup._SALT) * near_dedup._FACTOR)
    two = np.argsort(h, axis=0, kind="stable")[:2]
    least = np.take_along_axis(h, two, axis=0)
    place = near_dedup._PLACE
    ordered = np.where(two[0] <= two[1], least[0] * place[0] + least[1], least[1] * place[0] + least[0])
    band = np.arange(near_dedup.BANDS, dtype=np.uint64)
    for row in near_dedup._mix(ordered).reshape(near_dedup.BANDS, near_dedup.ROWS).T:
        band = near_dedup._mix(band * place[1] + row)
    assert near_dedup._bands(words).tolist() == band.view(np.int64).tolist()
    assert near_dedup.matched_runs(list("abcabba"), list("cbabac"), 13) is not None
    assert near_dedup.matched_runs(list("abcabba"), list("cbabac"), 4) is None
    assert near_dedup.matched_runs(list("abcdefg"), list("abxdefg"), 2) == near_dedup.matched_runs(list("abcdefg"), list("abxdefg"), 14)


def test_near_copies_with_repeated_and_null_ids(spark):
    text = _prose(80, 9)
    rows = [(1, text), (1, _prose(80, 10)), (2, text + " end"), (None, text), (None, _prose(80, 11)), (3, " " + text.replace(" ", "  "))]
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(1, text), (1, rows[1][1]), (0, rows[4][1])])


def test_bpe(edge, empty):
    ranks = bpe.Tables(open(RANKS, "rb").read(), public_tokenizers.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.decode(bpe.encode(edge, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in both.collect():
        assert r["token_ids"] == lib.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_unbroken_texts(monkeypatch):
    import base64

    import pyarrow as pa

    monkeypatch.setattr(bpe, "MAX_MATCHES", 500)
    monkeypatch.setattr(bpe, "CUT_BYTES", 50_000)
    tables, rng = bpe.Tables(open(RANKS, "rb").read(), public_tokenizers.PATTERN), random.Random(7)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tables.ranks, special_tokens={})
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(300)) for _ in range(50)]
    texts += [base64.b64encode(rng.randbytes(2000)).decode() for _ in range(20)] + ["ab" * 20_000, None, "\u2003 x \u00a0 "]
    ids = tables.encode(pa.array(texts))
    assert ids.to_pylist() == [lib.encode_ordinary(t or "") for t in texts]
    assert [b.decode() for b in tables.decode(ids).to_pylist()] == [t or "" for t in texts]


def test_bpe_in_little_memory():
    """Matches as lists take a fraction of token rows; decoding needs no query."""
    import pyarrow as pa

    tables, rng = bpe.Tables(open(RANKS, "rb").read(), public_tokenizers.PATTERN), random.Random(8)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tables.ranks, special_tokens={})
    tables.db.execute("SET memory_limit = '90MB'")
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(150)]
    texts += [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 15))) + "\n " * (i % 3 == 0) for _ in range(40)) for i in range(2000)]
    ids = tables.encode(pa.array(texts))
    assert ids.to_pylist() == [lib.encode_ordinary(t) for t in texts]
    tables.db.close()
    assert tables.decode(ids).to_pylist() == [t.encode() for t in texts]
    assert tables.decode(pa.array([[], None, ids[0].as_py(), []], ids.type)).to_pylist() == [b"", b"", texts[0].encode(), b""]
    with pytest.raises(ValueError):
        tables.decode(pa.array([[65535]], ids.type))


def test_toxicity(spark, edge, empty):
    rows = [(i, _prose(60, i) + (" awful nasty" * (1 + i % 4) if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxicity.grade(docs, model).alias("g")).select("doc_id", "g.*").toPandas()
    assert ((got.p_toxic >= 0.5) == (got.doc_id % 3 == 0)).all() and got.severity.between(0, toxicity.GRADES - 1).all()
    assert got[got.doc_id % 12 == 9].severity.mean() > got[got.doc_id % 12 == 0].severity.mean()
    assert edge.select(toxicity.grade(edge, model)).count() == edge.count()
    clean = toxicity.fit(empty, labels)
    assert edge.select(toxicity.grade(edge, clean)["severity"].alias("s")).filter("s <> 0").count() == 0


def test_lm_backoff(spark, edge, empty):
    train = spark.createDataFrame([("a b a b c",)], "text string")
    pairs, words = lm_score.count_tables(train)
    docs = spark.createDataFrame([(1, "a b"), (2, "c a"), (3, ""), (4, "zz")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["log_score"] for r in lm_score.score(docs, pairs, words).collect()}
    assert np.isclose(got[1], np.log(2 / 5) + np.log(2 / 2)) and np.isclose(got[2], np.log(1 / 5) + np.log(0.4 * 2 / 5))
    assert got[3] is None and np.isclose(got[4], np.log(1 / 5))


def _leave_one_out(texts):
    """Mean log score of every text under the counts of the others, by dictionaries."""
    words = [(t or "").split() for t in texts]
    uni, duo = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t, t[1:]))
    out = []
    for t in words:
        u, d = Counter(t), Counter(zip(t, t[1:]))
        n = lambda w: max(uni[w] - u[w], 1)  # noqa: B023, E731
        rest = max(sum(uni.values()) - len(t), 1)
        s = [np.log(n(w) / rest) for w in t[:1]]
        for v, w in zip(t, t[1:]):
            seen = duo[v, w] - d[v, w]
            s.append(np.log(seen / n(v)) if seen else np.log(0.4 * n(w) / rest))
        out.append(sum(s) if t else None)
    return out


@pytest.mark.parametrize("heavy,hot", [(200_000, 10_000), (5, 5), (1, 1)])
def test_corpus_scores(spark, edge, empty, monkeypatch, heavy, hot):
    """Whatever is broadcast or collapsed, every row has the brute-force score."""
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "SAMPLE", 2)
    monkeypatch.setattr(lm_score, "SLICE_WORDS", 50 * hot)
    rows = edge.select("doc_id", "text").collect()
    got = {(r["doc_id"], r["n_words"]): r["log_score"] for r in lm_score.score_corpus(edge).collect()}
    assert lm_score.score_corpus(edge).count() == len(rows)
    for row, score in zip(rows, _leave_one_out([r["text"] for r in rows])):
        mine = got[row["doc_id"], len((row["text"] or "").split())]
        assert mine == (None if score is None else pytest.approx(score))
    assert lm_score.score_corpus(empty).count() == 0


def test_gibberish_ranks_below_prose(spark):
    prose = [" ".join(WORDS[(i + j) % 9] for j in range(40)) for i in range(30)]
    noise = " ".join(f"q{j}x" for j in range(40))
    docs = spark.createDataFrame(list(enumerate([*prose, noise, noise[:20] * 9])), "doc_id bigint, text string")
    means = {r["doc_id"]: r["log_score"] / r["n_words"] for r in lm_score.score_corpus(docs).collect()}
    assert max(means[30], means[31]) < min(means[i] for i in range(30))


def test_pipeline_matches_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.run(spark, SF)
    assert kept.columns[:len(docs.columns)] == docs.columns and kept.filter("NOT round_trip").count() == 0
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    want, seen = [], set()
    for i in sorted(i for i, t in text.items() if any(map(str.isalpha, t))):
        if (key := " ".join(text[i].split())) not in seen:
            seen.add(key)
            want.append(i)
    parent = {i: i for i in want}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingles = {i: set(zip(*(text[i].split()[k:] for k in range(5)))) for i in want}
    for i in want:
        for j in want:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) > 0:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert ids == sorted(i for i in want if root(i) == i)


def test_pipeline_keeps_the_mix(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, _prose(1 + i % 40, i), "b" if i % 3 == 0 else "a") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[3:])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 150)
    try:
        out = pipeline.run(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(out.inputFiles()) > 10
    got = out.collect()
    assert len(got) == 3000 and [r["mix_order"] for r in got] == sorted({r["mix_order"] for r in got})
    assert all(r["lane"] == r["source"] for r in got)
    share = 1000 ** 0.5 / (1000 ** 0.5 + 2000 ** 0.5)
    for n in range(64, 2200, 64):  # both sources last that long
        assert abs(sum(r["source"] == "b" for r in got[:n]) - share * n) < 64 + n / mixing.CYCLE


def test_pipeline_without_labels_keeps_documents(spark, edge):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = edge.withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.language(spark, docs, SF)
    want = [r["text"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted(want) and want


def test_pipeline_clashing_names_and_empty_table(spark, edge, tmp_path):
    clash = edge.withColumns({c: F.lit("mine") for c in (*corpus_pipeline.ADDED, "decoded", "_decoded", "row")})
    clash.write.parquet(f"{tmp_path}/clash/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/clash")
    rows = got.collect()
    assert set(got.columns) == set(clash.columns) and len(got.columns) == len(clash.columns)
    assert rows and all(r["round_trip"] is True and r["decoded"] == r["_decoded"] == r["row"] == "mine" for r in rows)
    assert [r["mix_order"] for r in rows] == sorted(r["mix_order"] for r in rows)
    clash.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_many_spans_settle_by_blocks(spark, monkeypatch):
    """One passage in many surroundings: spans of an anchor differ at one edge, and rows must not come one a window."""
    rng, sizes, kept = random.Random(5), [], suffix_dedup.materialize
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, other = noise(420), noise(40)
    texts = [noise(rng.randint(150, 400)) + passage + (other if i % 3 else "") + noise(rng.randint(150, 400)) for i in range(60)]
    texts += [noise(300) + passage[:230] + noise(300), noise(300) + passage[190:] + noise(300), "é" * 300, passage]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    seen = Counter(t.encode()[p:p + 200] for _, t in rows for p in range(len(t.encode()) - 199))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        want.append((i, bytes(np.frombuffer(b, np.uint8)[~gone])))

    def counted(df, name):
        table = kept(df, name)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(suffix_dedup, "ARRAY_SPANS", 5)
    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == sorted(want)
    blocks, spans = [n for name, n in sizes if name == "blocks"], dict(sizes)["parts"]
    assert len(blocks) == len(suffix_dedup.BLOCKS) and max(blocks) <= 6 * spans


def test_frequent_matches_stay_encoded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_MATCHES", 20)
    with open(RANKS, "rb") as f:
        tables = bpe.Tables(f.read(), public_tokenizers.PATTERN)
    got = {}
    for i in range(12):
        texts = [f"xqzvk wvvkq zzqj{chr(97 + i)}{chr(98 + i)}qx jqkx{chr(97 + i)}w {_prose(3, i)}"]
        got[texts[0]] = tables.encode(pa.array(texts)).to_pylist()[0]
        if i > 2:
            assert b" wvvkq" in tables.place and len(tables.place) <= 20 + 20
    with open(RANKS, "rb") as f:
        fresh = bpe.Tables(f.read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "MAX_MATCHES", 1000)
    assert fresh.encode(pa.array(list(got))).to_pylist() == list(got.values())


def test_batches_are_cut_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN)
    assert spark.conf.get(key) == "4m"
    spark.conf.set(key, "1m")
    bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_bands_bound_their_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    assert near_dedup.band_members(spark.createDataFrame([(1, "a b")], "node bigint, text string")).count() == near_dedup.BANDS
    assert spark.conf.get(key) == "4m"
    spark.conf.unset(key)
