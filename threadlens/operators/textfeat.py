"""Feature families added to a table of cleaned texts; no family shuffles rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text

FAMILY_COLUMNS = {
    "length": [
        "char_count", "word_count", "sentence_count", "avg_word_length", "avg_sentence_length",
        "sentence_length_std", "paragraph_count",
    ],
    "readability": ["flesch_kincaid", "gunning_fog", "coleman_liau", "automated_readability"],
    "vocab": ["ttr", "hapax_ratio"],
    "stopword": ["stopword_ratio"],
    "punctuation": ["punctuation_density"],
    "special": ["exclamation_count", "question_count", "ellipsis_count", "emoji_count"],
    "ngram": ["trigram_repeat_rate", "fourgram_repeat_rate"],
    "hedging": ["hedging_per_100w"],
    "self": ["self_reference_rate"],
    "burstiness": ["burstiness"],
}

# Arrays that several features share; each is computed once per row, then dropped.
_SHARED = {
    "__lower": lambda c: F.lower(c),
    "__marked": lambda c: text.marked_words(c),
    "__words": lambda c: text.unmark(F.col("__marked")),
    "__lens": lambda c: text.sentence_lengths(F.col("__marked")),
    "__low": lambda c: text.words(F.col("__lower")),
    "__alpha": lambda c: F.sort_array(text.alphabetic_words(F.col("__low"))),
    "__syl": lambda c: text.syllable_counts(c),
    "__g3": lambda c: text.ngrams(F.col("__low"), 3),
    "__g4": lambda c: text.ngrams(F.col("__low"), 4),
}
_NEEDS = {
    "length": ["__marked", "__words", "__lens"],
    "readability": ["__marked", "__words", "__lens", "__syl"],
    "vocab": ["__lower", "__low", "__alpha"],
    "stopword": ["__lower", "__low"],
    "ngram": ["__lower", "__low", "__g3", "__g4"],
    "hedging": ["__lower", "__marked", "__words"],
    "self": ["__lower", "__low"],
    "burstiness": ["__marked", "__lens"],
}


def add_features(df: DataFrame, col: str, families: list[str] | None = None) -> DataFrame:
    """Add the columns of the named families (all by default) for the text in ``col``."""
    families = list(FAMILY_COLUMNS) if families is None else families
    c = F.col(col)
    shared = [name for name in _SHARED if any(name in _NEEDS.get(f, []) for f in families)]
    # One projection per array: those that build on another array must see it as a column.
    for name in shared:
        df = df.withColumn(name, _SHARED[name](c))
    w, lens, low = (F.col(n) for n in ("__words", "__lens", "__low"))
    build = {
        "length": lambda: text.length_features(c, w, lens),
        "readability": lambda: text.readability(c, w, lens, F.col("__syl")),
        "vocab": lambda: text.vocab_richness(F.col("__alpha")),
        "stopword": lambda: {"stopword_ratio": text.stopword_ratio(low)},
        "punctuation": lambda: {"punctuation_density": text.punctuation_density(c)},
        "special": lambda: text.special_punct(c),
        "ngram": lambda: {
            "trigram_repeat_rate": text.ngram_repetition(F.col("__g3")),
            "fourgram_repeat_rate": text.ngram_repetition(F.col("__g4")),
        },
        "hedging": lambda: {"hedging_per_100w": text.hedging_rate(F.col("__lower"), F.size(w))},
        "self": lambda: {"self_reference_rate": text.self_reference_rate(low)},
        "burstiness": lambda: {"burstiness": text.burstiness(lens)},
    }
    out = {}
    for f in families:
        out.update(build[f]())
    return df.withColumns(out).drop(*shared)
