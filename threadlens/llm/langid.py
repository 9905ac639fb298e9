"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a context tree of order three with the counts of a bounded sample of its documents.
In a context seen n times with d distinct next bytes, a byte seen c times costs -log2(c / (n + d)) bits;
another byte costs the escape, -log2(d / (n + d)), plus its cost in the context that is one byte
shorter, down to a uniform distribution over 256 bytes. Statistics are frozen, so the costs of all counted
strings and the escapes of all contexts are tabulated once, as sorted keys for each language; a lookup is a
binary search, made once for each different four-byte string of a slice. The code length of a text is the
sum over its bytes. The shortest code names the language; the score is 2^-bits of that language over the sum of all.

The only bound of the model is the sample, ``docs_per_lang`` whole documents a language; all their bytes, four-byte
strings and contexts count.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
nothing is labelled. Rows with a null language or text do not train. Columns are handed through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.ranking import top_n_per_group

DOCS_PER_LANG = 500
#: Bytes, the symbol before the start of a text, and the bits that a symbol takes in a key.
SYMBOLS, PAD, BITS = 256, 256, 9
ORDER = 3
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _packed(c: np.ndarray) -> np.ndarray:
    """Each symbol from the fourth on, with the three before it."""
    return c[:-3] << 3 * BITS | c[1:-2] << 2 * BITS | c[2:-1] << BITS | c[3:]


def _gram_counts(texts: pa.Array) -> pa.Array:
    """Per text, the packed four-byte strings (padding before the start) and their counts."""
    out = []
    for text in texts.to_pylist():
        b = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.int64)
        keys, n = np.unique(_packed(np.concatenate([np.full(ORDER, PAD), b])), return_counts=True)
        out.append([{"key": k, "n": c} for k, c in zip(keys.tolist(), n.tolist())])
    return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Code lengths in bits of the counted strings and of the escapes, for each language and order."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs = langs
        order = np.argsort(lang, kind="stable")
        ends = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        own = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.tables = [[self._table(key[o], n[o], size) for size in range(ORDER, -1, -1)] for o in own]

    @staticmethod
    def _table(key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Strings with a context of ``size`` bytes and their bits, contexts and the bits of their escapes."""
        grams, at = np.unique(key & (1 << BITS * (size + 1)) - 1, return_inverse=True)
        count = np.bincount(at, weights=n)
        contexts, of = np.unique(grams >> BITS, return_inverse=True)
        kinds = np.bincount(of)
        all_of = np.bincount(of, weights=count) + kinds
        return grams, -np.log2(count / all_of[of]), contexts, -np.log2(kinds / all_of)

    def costs(self, keys: np.ndarray, lang: int) -> np.ndarray:
        """Bits of the last byte of each packed string in language number ``lang``."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for size, (grams, bits, contexts, escapes) in zip(range(ORDER, -1, -1), self.tables[lang]):
            keys = keys & (1 << BITS * (size + 1)) - 1
            at, hit = _found(grams, keys)
            out[todo[hit]] += bits[at[hit]]
            todo, keys = todo[~hit], keys[~hit]
            at, seen = _found(contexts, keys >> BITS)
            out[todo[seen]] += escapes[at[seen]]
        out[todo] += 8  # uniform over 256 bytes
        return out

    @property
    def cost(self) -> np.ndarray:
        """Bits of every byte (rows context by context) after all longest contexts, for each language."""
        contexts = np.unique(np.concatenate([t[0][2] for t in self.tables]))
        keys = (contexts[:, None] << BITS | np.arange(SYMBOLS)).ravel()
        return np.stack([self.costs(keys, k) for k in range(len(self.langs))], axis=1)

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text in each language."""
        data = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset:data.offset + len(data) + 1]
        flat = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        out = np.zeros((len(texts), len(self.langs)))
        starts = ends[:-1]
        for lo in range(0, len(flat), SLICE_BYTES):
            hi = min(lo + SLICE_BYTES, len(flat))
            c = np.full(hi - lo + ORDER, PAD, dtype=np.int64)
            have = flat[max(0, lo - ORDER):hi]
            c[len(c) - len(have):] = have
            keys = _packed(c)
            for j in range(ORDER):  # the bytes before a text's start are padding
                at = starts + j
                at = at[(at >= lo) & (at < hi) & (at < ends[1:])] - lo
                padded = PAD << 3 * BITS | PAD << 2 * BITS | PAD << BITS
                low = BITS * (j + 1)
                keys[at] = padded >> low << low | keys[at] & (1 << low) - 1
            code, different = pd.factorize(keys)
            first, last = np.searchsorted(ends, lo, side="right") - 1, np.searchsorted(ends, hi, side="left")
            docs = np.arange(first, last)
            a, b = np.maximum(ends[docs], lo) - lo, np.minimum(ends[docs + 1], hi) - lo
            docs, a = docs[b > a], a[b > a]
            for k in range(len(self.langs)):
                out[docs, k] += np.add.reduceat(self.costs(different, k)[code], a)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        ok = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.bits(texts)
        best = bits.argmin(axis=1) if len(bits) else np.zeros(0, dtype=int)
        share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1) if len(bits) else np.zeros(0)
        return [self.langs[b] if o else UNKNOWN for b, o in zip(best, ok)], np.where(ok, share, 0.0)


def fit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    docs_per_lang: int = DOCS_PER_LANG,
) -> Model:
    """A model of the languages in ``lang_col`` from a bounded sample, drawn by a hash of the id.

    Grams are counted on the executors; the driver gets the counts of the sample.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("o", F.xxhash64("id", F.length("text")))
    picked = top_n_per_group(rows.drop("text"), "lang", [F.col("o"), F.col("id")], docs_per_lang)
    sample = rows.join(F.broadcast(picked.select("lang", "o").distinct()), ["lang", "o"], "left_semi")
    kind = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    grams = F.arrow_udf(_gram_counts, kind)
    counts = sample.select("lang", F.explode(grams("text")).alias("g")).groupBy("lang", "g.key").agg(F.sum("g.n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got["lang"].unique().to_pylist()))
    code = pc.index_in(got["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    return Model(langs, code, got["key"].to_numpy(), got["n"].to_numpy())


def has_letter(df: DataFrame, text_col: str = "text") -> Column:
    """Whether a text could be given a language: it is not null and has a letter."""

    @F.arrow_udf(T.BooleanType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], pa.bool_())

    return run(F.col(text_col))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column struct<lang: string, score: double> for the texts of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        langs, score = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], names=["lang", "score"])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.arrow_udf(run, kind)(F.col(text_col))
