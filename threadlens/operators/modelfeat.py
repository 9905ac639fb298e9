"""Features that rest on a lexicon, a language model or an encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import lexicons as lx
from threadlens.functions import text
from threadlens.operators.ranking import BROADCAST_ROWS, small_side
from threadlens.session import materialize

TOKEN_PATTERN = r"[^\p{L}\p{N}']+"


def word_tokens(c: Column) -> Column:
    """Runs of letters, digits and apostrophes."""
    return F.array_remove(F.split(c, TOKEN_PATTERN), "")


def suffix_tag(token: Column) -> Column:
    """Tag of a word outside the lexicon: by suffix, capital initial, else noun."""
    low = F.lower(token)
    out = F.when(token.rlike(r"^\p{Lu}"), "NNP")
    for suffix, tag in lx.SUFFIX_TAGS:
        out = out.when(F.endswith(low, F.lit(suffix)), tag)
    return out.otherwise("NN")


def lexicon_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A caller's lexicon as a table; a broadcast is only hinted for one of checked length."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= 200_000 else df


def pos_distribution(
    df: DataFrame, col: str, id_col: str = "id", word_tags: dict[str, list[str]] = lx.WORD_TAGS
) -> DataFrame:
    """Share of each tag among the tokens of a text, plus the formality score.

    Tokens of one text sit in one partition, so the map-side aggregation leaves one row per text for
    the shuffle. Texts without tokens get zeros.
    """
    rows = [(w, tag) for tag, ws in word_tags.items() for w in ws]
    lexicon = lexicon_table(df.sparkSession, rows, "__low string, __tag string")
    tokens = df.select(id_col, F.explode_outer(word_tokens(F.col(col))).alias("__tok"))
    tokens = tokens.withColumn("__low", F.lower("__tok")).join(lexicon, "__low", "left")
    tag = F.coalesce("__tag", suffix_tag(F.col("__tok")))
    tagged = tokens.withColumn("__t", F.when(F.col("__tok").isNotNull(), tag))
    counts = tagged.groupBy(id_col).agg(
        F.count("__t").alias("__n"), *[F.count_if(F.col("__t") == t).alias(f"pos_{t}") for t in lx.POS_TAGS]
    )
    share = {t: F.when(F.col("__n") > 0, F.col(f"pos_{t}") / F.col("__n")).otherwise(0.0) for t in lx.POS_TAGS}
    out = counts.select(id_col, *[c.alias(f"pos_{t}") for t, c in share.items()])
    return out.withColumn(
        "formality_score", text.formality_score({t: F.col(f"pos_{t}") for t in lx.POS_TAGS})
    )


def _compound(s: Column) -> Column:
    """Valence sum squeezed into -1..1 (Hutto and Gilbert 2014)."""
    return s / F.sqrt(s * s + 15)


def sentiment_scores(
    df: DataFrame, col: str, id_col: str = "id", valence: dict[str, float] = lx.VALENCE
) -> DataFrame:
    """Compound score, positive, negative and neutral shares, and the spread over sentences."""
    lexicon = lexicon_table(df.sparkSession, list(valence.items()), "__low string, __val double")
    sents = df.select(id_col, F.posexplode_outer(text.sentences(F.col(col))).alias("__s", "__sent"))
    tokens = sents.select(
        id_col, "__s", F.explode_outer(word_tokens(F.lower("__sent"))).alias("__low")
    ).join(lexicon, "__low", "left")
    v = F.coalesce("__val", F.lit(0.0))
    per_sentence = tokens.groupBy(id_col, "__s").agg(
        F.sum(v).alias("sum"), F.sum(F.greatest(v, F.lit(0.0))).alias("pos"),
        F.sum(F.least(v, F.lit(0.0))).alias("neg"),
        F.count_if(v > 0).alias("n_pos"), F.count_if(v < 0).alias("n_neg"),
        F.count("__low").alias("n_tok"),
    )
    per_text = per_sentence.groupBy(id_col).agg(
        F.sum("sum").alias("sum"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n_tok").alias("n_tok"),
        F.count("__s").alias("n_sent"), F.stddev_pop(_compound(F.col("sum"))).alias("spread"),
    )
    # A hit weighs its valence plus one, as a neutral token weighs one.
    pos = F.col("pos") + F.col("n_pos")
    neg = -F.col("neg") + F.col("n_neg")
    neutral = F.col("n_tok") - F.col("n_pos") - F.col("n_neg")
    total = pos + neg + neutral
    def share(x):
        return F.when(total > 0, x / total).otherwise(0.0)
    return per_text.select(
        id_col, _compound(F.col("sum")).alias("sentiment_compound"),
        share(pos).alias("sentiment_pos"), share(neg).alias("sentiment_neg"),
        share(neutral).alias("sentiment_neu"),
        F.when(F.col("n_sent") >= 2, F.col("spread")).otherwise(0.0).alias("sentiment_variability"),
    )


@dataclass
class BigramModel:
    """Counts of word pairs (``a, b, n_ab``), the number of different words, and the count added to every pair."""

    pairs: DataFrame
    vocabulary: int
    k: float = 0.1


def _lower_words(df: DataFrame, col: str, max_tokens: int | None, *keep: str) -> DataFrame:
    toks = text.words(F.lower(F.col(col)))
    return df.select(*keep, (F.slice(toks, 1, max_tokens) if max_tokens else toks).alias("__w"))


def _word_pairs(words: DataFrame, *keep: str) -> DataFrame:
    n_pairs = F.greatest(F.size("__w") - 1, F.lit(0))
    first, second = F.slice("__w", F.lit(1), n_pairs), F.slice("__w", F.lit(2), n_pairs)
    both = F.arrays_zip(first.alias("a"), second.alias("b"))
    return words.select(*keep, F.explode(both).alias("p")).select(*keep, "p.a", "p.b")


def fit_bigrams(df: DataFrame, col: str, k: float = 0.1, max_tokens: int | None = None) -> BigramModel:
    """Word-pair counts of all texts of ``df``; they combine map-side."""
    words = _lower_words(df, col, max_tokens)
    pairs = materialize(_word_pairs(words).groupBy("a", "b").agg(F.count("*").alias("n_ab")), "bigrams")
    size = words.select(F.explode("__w").alias("w")).agg(F.countDistinct("w")).first()[0]
    return BigramModel(pairs, size, k)


def score_bigrams(
    df: DataFrame, col: str, model: BigramModel, id_col: str = "id", max_tokens: int | None = None
) -> DataFrame:
    """``id`` and ``perplexity`` of every text of two words or more under kept counts.

    A text starts from the score of so many new pairs of new words; every kept pair and every kept first word adds its part. The most
    frequent ones are broadcast, so most occurrences are summed where they are; only the others meet the rest of the table by shuffle.
    """
    if model.k <= 0:
        return _score_unsmoothed(df, col, model, id_col, max_tokens)
    room = model.k * max(model.vocabulary, 1)
    firsts = materialize(model.pairs.groupBy("a").agg(F.sum("n_ab").alias("n")), "first-words")
    # A word holds no space, so a first word is a key beside the pairs, and one string a key of two.
    kept = model.pairs.select(F.concat_ws(" ", "a", "b").alias("key"), F.col("n_ab").alias("n"), F.log1p(F.col("n_ab") / model.k).alias("part"))
    kept = kept.unionAll(firsts.select(F.col("a").alias("key"), "n", (-F.log1p(F.col("n") / room)).alias("part")))
    cut, whole = _frequent_from(kept, "n")
    frequent = F.broadcast(materialize(kept.filter(F.col("n") >= cut).drop("n"), "frequent-pairs"))
    pairs = _word_pairs(_lower_words(df, col, max_tokens, id_col).withColumnRenamed(id_col, "__of"), "__of")
    keys = pairs.select("__of", F.posexplode(F.array(F.concat_ws(" ", "a", "b"), "a")).alias("first", "key"))
    parts = keys.join(frequent, "key", "left").groupBy("__of").agg(F.sum("part").alias("part"), F.count_if(F.col("first") == 0).alias("n"))
    if not whole:
        others = keys.drop("first").join(frequent, "key", "left_anti").join(kept.filter(F.col("n") < cut).drop("n"), "key")
        parts = parts.unionAll(others.groupBy("__of").agg(F.sum("part").alias("part"), F.lit(0).cast("long").alias("n")))
    scored = parts.groupBy(F.col("__of").alias(id_col)).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("part"), F.sum("n").alias("n"))
    new = F.log(F.lit(model.k / room))
    return scored.select(id_col, F.exp(-(F.col("part") / F.col("n") + new)).alias("perplexity"))


def _frequent_from(table: DataFrame, n: str) -> tuple[int, bool]:
    """The least power of two from which on the counts ``n`` of a table are of rows few enough to broadcast, and whether those are all."""
    rows = table.groupBy(F.length(F.bin(n)).alias("bits")).agg(F.count("*").alias("rows")).orderBy(F.desc("bits")).collect()
    total, cut = 0, 1 << 62
    for r in rows:  # 64 at most
        total += r["rows"]
        if total > BROADCAST_ROWS:
            return cut, False
        cut = 1 << (r["bits"] - 1)
    return cut, True


def _score_unsmoothed(df: DataFrame, col: str, model: BigramModel, id_col: str, max_tokens: int | None) -> DataFrame:
    """``score_bigrams`` of a model that adds nothing: pairs that were not kept have no score and do not count."""
    pairs = _word_pairs(_lower_words(df, col, max_tokens, id_col).withColumnRenamed(id_col, "__of"), "__of")
    firsts = model.pairs.groupBy("a").agg(F.sum("n_ab").alias("n_a"))
    room = model.k * max(model.vocabulary, 1)
    known = model.pairs.join(firsts, "a").select("a", "b", F.log((F.col("n_ab") + model.k) / (F.col("n_a") + room)).alias("log_p"))
    new = F.when(F.col("log_p").isNull(), F.col("a"))
    part = pairs.join(known, ["a", "b"], "left").groupBy("__of", new.alias("new")).agg(
        F.sum("log_p").alias("total"), F.count("*").alias("n"))
    # A word holds no space, so sums of kept pairs match no first word, and being different they share no task.
    part = part.withColumn("a", F.coalesce("new", F.concat(F.lit(" "), F.xxhash64("__of").cast("string"))))
    rest = F.log(F.lit(model.k) / (F.coalesce("n_a", F.lit(0)) + room))
    both = part.join(firsts, "a", "left").select(
        "__of", F.when(F.col("new").isNull(), F.col("total")).otherwise(F.col("n") * rest).alias("total"), "n")
    scored = both.groupBy(F.col("__of").alias(id_col)).agg(
        F.sum("total").alias("total"), F.sum(F.when(F.col("total").isNotNull(), F.col("n"))).alias("n"))
    return scored.select(id_col, F.exp(-F.col("total") / F.col("n")).alias("perplexity"))


def corpus_perplexity(
    df: DataFrame, col: str, id_col: str = "id", split: str = "split", k: float = 0.1,
    max_tokens: int | None = None,
) -> DataFrame:
    """Perplexity under an add-k bigram model fit on the training split; null below two tokens."""
    model = fit_bigrams(df.filter(F.col(split) == "train"), col, k, max_tokens)
    return df.select(id_col, split).join(score_bigrams(df, col, model, id_col, max_tokens), id_col, "left")


def token_limit_truncate(c: Column, n: int = lx.MAX_TOKENS_PER_TEXT) -> Column:
    """The text as it is when it has at most n tokens, else its first n tokens."""
    flat = text.normalize_newlines(c)
    toks = text.words(flat)
    return F.when(F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(flat)


SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]


def build_vocabulary(df: DataFrame, col: str, size: int = 30_522) -> DataFrame:
    """Token ids by frequency, after the four special tokens.

    Only the ``size`` most frequent tokens survive the top-k merge, so the final numbering is over a
    table of known length.
    """
    counts = df.select(F.explode(word_tokens(F.lower(col))).alias("token")).groupBy("token").count()
    top = counts.orderBy(F.desc("count"), "token").limit(size - len(SPECIAL_TOKENS))
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "token"))
    return top.select("token", (rank + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"))


def encode_tokens(
    df: DataFrame, col: str, vocabulary: DataFrame, id_col: str = "id", length: int = lx.ENCODED_LENGTH
) -> DataFrame:
    """Fixed-length ids [CLS] … [SEP] [PAD]…, with an attention mask."""
    kept = F.slice(word_tokens(F.lower(col)), 1, length - 2)
    tokens = df.select(id_col, F.posexplode_outer(kept).alias("__pos", "token"))
    known = tokens.join(small_side(vocabulary, "vocabulary"), "token", "left")
    ids = F.when(F.col("token").isNotNull(), F.struct("__pos", F.coalesce("token_id", F.lit(1)).alias("id")))
    body = known.groupBy(id_col).agg(F.sort_array(F.collect_list(ids)).alias("__b"))
    full = F.concat(F.array(F.lit(2)), F.transform("__b", lambda x: x["id"]), F.array(F.lit(3)))
    padded = F.concat(full, F.array_repeat(F.lit(0), F.lit(length) - F.size(full)))
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size(full)), F.array_repeat(F.lit(0), F.lit(length) - F.size(full))
    )
    return body.select(id_col, padded.alias("input_ids"), mask.alias("attention_mask"))


_SLOT_BITS = 16
Encoder = Callable[[list[str]], np.ndarray]


def _slots(tokens: Column) -> Column:
    """Hash slot per token: the first four hex digits of its md5."""
    return F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))


def slot_weights(df: DataFrame, col: str) -> np.ndarray:
    """Inverse document frequency per hash slot: 65,536 numbers, whatever the corpus size."""
    return _weights(df.select(_slots(text.words(F.lower(F.col(col)))).alias("__slots")), "__slots")


def _weights(df: DataFrame, slots_col: str) -> np.ndarray:
    """The same from the slots of each text; rows without a list do not count."""
    n_slots = 1 << _SLOT_BITS
    slots = F.array_distinct(slots_col)
    # Slot -1 occurs once per text and so counts the texts in the same pass.
    counted = df.select(F.explode(F.array_append(slots, F.lit(-1))).alias("slot")).groupBy("slot").count()
    freq = np.zeros(n_slots)
    n = 0
    for slot, count in counted.collect():
        if slot < 0:
            n = count
        else:
            freq[slot] = count
    return np.log((n + 1) / (freq + 1)) + 1.0


#: Tokens of one slice of a batch; a batch has so many rows, but texts of any length.
SLICE_TOKENS = 1 << 18


def token_slices(lists: pa.Array, most: int = SLICE_TOKENS) -> Iterator[pa.Array]:
    """A batch of token lists in consecutive slices of at most ``most`` tokens, or of one row; one slice if it is empty."""
    ends = np.cumsum(np.asarray(lists.value_lengths()).astype("int64"))
    start, done = 0, 0
    while start < len(lists) or not start:
        stop = max(int(np.searchsorted(ends, done + most, "right")), start + 1)
        yield lists.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1]) if len(ends) else 0


def _projection(idf: np.ndarray, dim: int) -> Callable[[Column], Column]:
    """Unit vector of ``dim`` dimensions from a list of slots."""
    number = np.arange(len(idf))
    target, sign = number * 40503 % len(idf) * dim // len(idf), np.where(number * 30011 % 65537 % 2 == 0, 1.0, -1.0)

    def project_slice(lists: pa.Array) -> pa.Array:
        size = np.asarray(lists.value_lengths()).astype("int64")
        cell = np.repeat(np.arange(len(lists)), size) * len(idf) + np.asarray(lists.flatten()).astype("int64")
        cell, tf = np.unique(cell, return_counts=True)
        row, slot = cell // len(idf), cell % len(idf)
        value = (1 + np.log(tf)) * idf[slot] * sign[slot]
        flat = np.bincount(row * dim + target[slot], value, minlength=len(lists) * dim).reshape(len(lists), dim)
        norm = np.linalg.norm(flat, axis=1, keepdims=True)
        flat = (flat / np.where(norm == 0, 1.0, norm)).astype("float32").ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(flat))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def project(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([project_slice(part) for part in token_slices(lists)])

    return project


def embed_texts(
    df: DataFrame, col: str, encoder: Callable[[], Encoder] | None = None, dim: int = lx.EMBEDDING_DIM,
    max_chars: int | None = None, weights: np.ndarray | None = None,
) -> DataFrame:
    """Add a unit-norm ``embedding``.

    The default is TF-IDF over hashed tokens, projected to ``dim`` dimensions by a sparse sign matrix with one non-zero per
    hash slot, both places and signs from multiplicative hashes of the slot. ``encoder`` is a factory called once per
    task for a model that turns a list of texts into a matrix. Only the text or its slots cross into Python.
    """
    source = F.coalesce(F.col(col), F.lit(""))
    source = F.substring(source, 1, max_chars) if max_chars else source
    vectors = T.ArrayType(T.FloatType())
    if encoder is not None:
        @F.pandas_udf(vectors)
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = encoder()
            for texts in batches:
                yield pd.Series(_unit_rows(np.asarray(model(texts.tolist()), dtype="float64")))
        return df.withColumn("embedding", encode(source))
    idf = slot_weights(df, col) if weights is None else weights
    return df.withColumn("embedding", _projection(idf, dim)(_slots(text.words(F.lower(source)))))


def _unit_rows(m: np.ndarray) -> list[np.ndarray]:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return list((m / np.where(norm == 0, 1.0, norm)).astype("float32"))


def text_chunks(
    df: DataFrame, col: str, id_col: str = "id", limit: int = lx.MAX_TOKENS_PER_TEXT,
    size: int = lx.LONG_TEXT_CHUNK,
) -> DataFrame:
    """One row per chunk: texts within the limit stay whole, longer ones are cut every ``size`` tokens."""
    toks = text.words(text.normalize_newlines(F.col(col)))
    n = F.size("__w")
    step = F.when(n > limit, F.lit(size)).otherwise(F.greatest(n, F.lit(1)))
    parts = df.select(id_col, toks.alias("__w")).withColumn("__step", step)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.col("__step"))
    cut = F.transform(starts, lambda s: F.array_join(F.slice("__w", s, F.col("__step")), " "))
    return parts.select(id_col, F.posexplode(cut).alias("chunk_no", "chunk"))


def embed_long_text(
    df: DataFrame, col: str, id_col: str = "id", limit: int = lx.MAX_TOKENS_PER_TEXT,
    size: int = lx.LONG_TEXT_CHUNK, **kwargs,
) -> DataFrame:
    """Mean of the chunk embeddings of each text, every chunk weighing the same.

    If document frequencies are to come from the chunks, their slots are written once for both passes over them.
    """
    from threadlens.operators.vectors import group_centroid

    chunks = text_chunks(df, col, id_col, limit, size)
    if any(kwargs.get(k) is not None for k in ("encoder", "weights", "max_chars")):
        vecs = embed_texts(chunks, "chunk", **kwargs)
    else:
        slotted = materialize(chunks.select(id_col, _slots(text.words(F.lower("chunk"))).alias("__slots")), "chunk-slots")
        project = _projection(_weights(slotted, "__slots"), kwargs.get("dim", lx.EMBEDDING_DIM))
        vecs = slotted.withColumn("embedding", project(F.coalesce("__slots", F.array().cast("array<int>"))))
    return group_centroid(vecs, id_col, "embedding", "embedding")
