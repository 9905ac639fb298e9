"""Rule-based sentiment (Hutto and Gilbert 2014): what the words around a word do to its valence.

A text's tokens are one array, and a word's score depends on it and the three tokens before it, so the rules are array
expressions on one row: no shuffle, no Python. In this order: a word in capitals in a text that is not all capitals counts more;
boosters among the three tokens before it add to or take from its strength, the nearer the more; a negation among them turns
it round; words before the first contrast word count half and those after it one and a half times; exclamation marks strengthen the sum.

Lexicons are literals of the plan, searched one by one per token; they are meant for some hundred words. Null and empty
texts, and texts without a word of the lexicon, have compound 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx

# Fixed values of the rules.
CAPITALS = 0.733
NEGATED = -0.74
NEARNESS = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
MARK, MOST_MARKS = 0.292, 4
ALL_CAPITALS = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


def _lookup(words: dict[str, float], token: Column) -> Column:
    if not words:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in words.items() for x in (k, float(v))]
    return F.coalesce(F.create_map(*pairs)[token], F.lit(0.0))


def add_rule_sentiment(
    df: DataFrame, col: str, valence: dict[str, float] = lx.VALENCE, boosters: dict[str, float] = lx.BOOSTERS,
    negations: list[str] = lx.NEGATIONS, contrasts: list[str] = lx.CONTRASTS,
) -> DataFrame:
    """Add ``sentiment_compound`` in -1..1, and ``n_negated`` and ``n_boosted``, the words of the lexicon under those rules."""
    text = F.coalesce(F.col(col), F.lit(""))
    negation = {w: 1.0 for w in negations}
    rows = df.withColumn("__tok", F.array_remove(F.split(text, r"[^\p{L}\p{N}']+"), ""))
    rows = rows.withColumn("__low", F.transform("__tok", F.lower)).withColumns({
        "__val": F.transform("__low", lambda t: _lookup(valence, t)),
        "__boost": F.transform("__low", lambda t: _lookup(boosters, t)),
        "__neg": F.transform("__low", lambda t: _lookup(negation, t)),
        "__caps": F.transform("__tok", lambda t: F.when(t.rlike(ALL_CAPITALS), CAPITALS).otherwise(0.0)),
        "__turn": F.array_min(F.filter(F.transform("__low", lambda t, i: F.when(t.isin(*contrasts or [""]), i)), lambda i: i.isNotNull())),
    })
    mixed = F.exists("__caps", lambda c: c > 0) & F.exists("__caps", lambda c: c == 0)

    def before(name: str, i: Column, d: int) -> Column:
        return F.coalesce(F.get(name, i - d), F.lit(0.0))

    def word(v: Column, i: Column) -> Column:
        boost = reduce(lambda a, b: a + b, [before("__boost", i, d) * NEARNESS[d - 1] for d in (1, 2, 3)])
        touched = reduce(lambda a, b: a | b, [before("__boost", i, d) != 0 for d in (1, 2, 3)])
        negated = reduce(lambda a, b: a | b, [before("__neg", i, d) > 0 for d in (1, 2, 3)])
        strength = F.abs(v) + F.when(F.col("__mixed"), F.get("__caps", i)).otherwise(0.0) + boost
        side = F.when(negated, NEGATED).otherwise(1.0)
        part = F.when(i < F.col("__turn"), BEFORE_CONTRAST).when(i > F.col("__turn"), AFTER_CONTRAST).otherwise(1.0)
        return F.when(v != 0, F.struct(
            (F.signum(v) * strength * side * part).alias("score"), negated.cast("int").alias("negated"), touched.cast("int").alias("boosted")))

    rows = rows.withColumn("__mixed", mixed).withColumn("__words", F.filter(F.transform("__val", word), lambda w: w.isNotNull()))

    def total(field: str, zero) -> Column:
        return F.aggregate("__words", F.lit(zero), lambda a, w: a + w[field])

    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(MOST_MARKS)) * MARK
    rows = rows.withColumn("__sum", total("score", 0.0)).withColumn("__sum", F.col("__sum") + F.signum("__sum") * marks)
    compound = F.col("__sum") / F.sqrt(F.col("__sum") * F.col("__sum") + 15)
    made = {"sentiment_compound": compound, "n_negated": total("negated", 0), "n_boosted": total("boosted", 0)}
    return rows.withColumns(made).drop("__tok", "__low", "__val", "__boost", "__neg", "__caps", "__turn", "__mixed", "__words", "__sum")
