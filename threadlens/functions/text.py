"""Text features as column expressions. All of them run inside the JVM, one row at a time, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx

# The white space of the Unicode standard, spelled out so every regex engine agrees on it.
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters as plain text, for the trim function.
WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
]))
URL_PATTERN = rf"http[^{WS}]+|www\.[^{WS}]+"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
ASTRAL_CLASS = r"[\x{10000}-\x{10FFFF}]"
# A final "e" after a consonant, with any closing punctuation behind it, is silent.
SILENT_E = rf"([b-df-hj-np-tv-xz])e([^\p{{L}}{WS}]*)$"
_SILENT_E_IN_TEXT = rf"(?<=[b-df-hj-np-tv-xz])e(?=[^\p{{L}}{WS}]*(?:[{WS}]|\z))"
_MARK = "\u0002"
_CUT = "\u0001"


def _ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def _occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal; the replace only runs where the literal is present."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return F.when(F.contains(c, F.lit(needle)), removed / len(needle)).otherwise(0).cast("long")


def _class_count(c: Column, char_class: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, char_class + "+", ""))).cast("long")


def _array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + x)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Drop URLs, squeeze runs of spaces and tabs, keep newlines, strip the ends; null becomes ''.

    The regular expressions only run or match where there is something to change.
    """
    has_url = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www."))
    no_url = F.when(has_url, F.regexp_replace(c, URL_PATTERN, "")).otherwise(c)
    return F.coalesce(strip(F.regexp_replace(no_url, "[ \t]{2,}|\t", " ")), F.lit(""))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, f"[{WS}]+"), "")


def sentences(c: Column) -> Column:
    """Split after runs of .!? that are followed by white space."""
    marked = F.regexp_replace(strip(c), rf"([.!?]+)[{WS}]+", "$1" + _CUT)
    return F.array_remove(F.split(marked, _CUT), "")


def marked_words(c: Column) -> Column:
    """Words with a mark between sentences, so one split serves words and sentence lengths."""
    return words(F.regexp_replace(strip(c), rf"([.!?]+)[{WS}]+", f"$1 {_CUT} "))


def unmark(marked: Column) -> Column:
    return F.array_remove(marked, _CUT)


def sentence_lengths(marked: Column) -> Column:
    """Words per sentence, from the distances between the marks of ``marked_words``."""
    at = F.transform(marked, lambda x, i: F.when(x == _CUT, i))
    marks = F.filter(at, lambda i: i.isNotNull())
    ends = F.array_append(marks, F.size(marked))
    starts = F.array_prepend(marks, F.lit(-1))
    lengths = F.zip_with(ends, starts, lambda e, s: (e - s - 1).cast("long"))
    return F.when(F.size(marked) > 0, lengths).otherwise(F.array().cast("array<bigint>"))


def population_std(lengths: Column) -> Column:
    """Population deviation of an integer array; sums stay integral so only the root is inexact."""
    n = F.size(lengths).cast("long")
    total = _array_sum(lengths)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    return F.sqrt((n * squares - total * total).cast("double")) / n


def length_features(c: Column, tokens: Column, lengths: Column) -> dict[str, Column]:
    n_words = F.size(tokens).cast("long")
    n_sents = F.size(lengths).cast("long")
    lines = F.filter(F.split(c, "\n"), lambda line: line.rlike(f"[^{WS}]"))
    return {
        "char_count": F.length(c).cast("long"),
        "word_count": n_words,
        "sentence_count": n_sents,
        "avg_word_length": _ratio(F.length(F.regexp_replace(c, f"[{WS}]+", "")), n_words),
        "avg_sentence_length": _ratio(n_words, n_sents),
        "sentence_length_std": F.when(n_sents > 1, population_std(lengths)).otherwise(0.0),
        "paragraph_count": F.size(lines).cast("long"),
    }


def syllable_counts(c: Column) -> Column:
    """Syllables per word: vowel groups less a silent final e, at least one.

    Both rules are applied to the whole text first, so the per-word step is plain length arithmetic.
    """
    voiced = F.regexp_replace(F.lower(c), _SILENT_E_IN_TEXT, "")
    marked = F.regexp_replace(voiced, "[aeiouy]+", _MARK)
    return F.transform(
        words(marked),
        lambda w: F.greatest(
            F.lit(1), F.length(w) - F.length(F.replace(w, F.lit(_MARK), F.lit("")))
        ).cast("long"),
    )


def readability(c: Column, tokens: Column, lengths: Column, syllables: Column) -> dict[str, Column]:
    """Flesch-Kincaid grade, Gunning fog, Coleman-Liau and ARI from their published formulas."""
    w = F.size(tokens).cast("double")
    s = F.greatest(F.size(lengths), F.lit(1)).cast("double")
    syl = _array_sum(syllables)
    hard = F.size(F.filter(syllables, lambda n: n >= 3))
    letters = _class_count(c, r"[\p{L}]")
    chars = F.length(F.regexp_replace(c, f"[{WS}]+", ""))
    scores = {
        "flesch_kincaid": 0.39 * (w / s) + 11.8 * (syl / w) - 15.59,
        "gunning_fog": 0.4 * (w / s + 100 * hard / w),
        "coleman_liau": 0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8,
        "automated_readability": 4.71 * (chars / w) + 0.5 * (w / s) - 21.43,
    }
    return {k: F.when(w > 0, v).otherwise(0.0) for k, v in scores.items()}


def repeated_values(sorted_arr: Column) -> Column:
    """Distinct values that occur more than once in a sorted array."""
    shifted = F.slice(sorted_arr, F.lit(2), F.greatest(F.size(sorted_arr) - 1, F.lit(0)))
    # zip_with pads the shorter side with null, so the last pair never compares equal.
    twin = F.zip_with(sorted_arr, shifted, lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(twin, lambda x: x.isNotNull()))


def alphabetic_words(lowered: Column) -> Column:
    return F.filter(lowered, lambda w: w.rlike(r"^\p{L}+\z"))


def vocab_richness(alpha_sorted: Column) -> dict[str, Column]:
    """Type-token ratio and share of words used once, over words made of letters only."""
    total = F.size(alpha_sorted)
    distinct = F.size(F.array_distinct(alpha_sorted))
    once = distinct - F.size(repeated_values(alpha_sorted))
    return {"ttr": _ratio(distinct, total), "hapax_ratio": _ratio(once, total)}


def word_list_ratio(lowered: Column, word_list: list[str]) -> Column:
    hits = F.filter(lowered, lambda w: w.isin(word_list))
    return _ratio(F.size(hits), F.size(lowered))


def stopword_ratio(lowered: Column, stopwords: list[str] = lx.STOPWORDS) -> Column:
    return word_list_ratio(lowered, stopwords)


def self_reference_rate(lowered: Column, first_person: list[str] = lx.FIRST_PERSON) -> Column:
    return word_list_ratio(lowered, first_person)


def punctuation_density(c: Column) -> Column:
    return _ratio(_class_count(c, PUNCT_CLASS), F.length(c))


def special_punct(c: Column) -> dict[str, Column]:
    return {
        "exclamation_count": _occurrences(c, "!"),
        "question_count": _occurrences(c, "?"),
        "ellipsis_count": _occurrences(c, "..."),
        "emoji_count": _class_count(c, ASTRAL_CLASS),
    }


def ngrams(lowered: Column, n: int) -> Column:
    """Sorted n-grams of a word array, built by zipping the array with its own shifts."""
    size = F.size(lowered)
    starts = F.greatest(size - (n - 1), F.lit(0))
    grams = F.slice(lowered, F.lit(1), starts)
    for k in range(1, n):
        grams = F.zip_with(
            grams, F.slice(lowered, F.lit(k + 1), starts), lambda a, b: F.concat(a, F.lit(" "), b)
        )
    return F.sort_array(grams)


def ngram_repetition(sorted_grams: Column) -> Column:
    """Share of distinct n-grams that occur more than once; 0 for texts shorter than n words."""
    return _ratio(
        F.size(repeated_values(sorted_grams)), F.size(F.array_distinct(sorted_grams))
    )


def hedging_rate(low: Column, n_words: Column, phrases: list[str] = lx.HEDGING_PHRASES) -> Column:
    """Phrase hits per hundred words of a lower-cased text; phrases are substrings and may overlap."""
    hits = reduce(lambda a, b: a + b, [_occurrences(low, p) for p in phrases])
    return _ratio(hits * 100, n_words)


def burstiness(lengths: Column) -> Column:
    """Population deviation over mean of the sentence lengths; 0 below two sentences."""
    total = _array_sum(lengths)
    ratio = population_std(lengths) * F.size(lengths) / total
    return F.when((F.size(lengths) >= 2) & (total > 0), ratio).otherwise(0.0)


def formality_score(shares: dict[str, Column]) -> Column:
    """Formal tag share over formal plus informal share; 0.5 when neither occurs."""
    formal = reduce(lambda a, b: a + b, [shares[t] for t in lx.FORMAL_TAGS])
    informal = reduce(lambda a, b: a + b, [shares[t] for t in lx.INFORMAL_TAGS])
    return F.when(formal + informal == 0, 0.5).otherwise(formal / (formal + informal))


def truncate_text(c: Column, k: int, ellipsis: bool = False) -> Column:
    head = F.substring(c, 1, k)
    if not ellipsis:
        return head
    return F.when(F.length(c) > k, F.concat(head, F.lit("..."))).otherwise(c)


def normalize_newlines(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(""))


def compose_text(title: Column, body: Column, sep: str = " ") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(body, F.lit("")))


def strip_id_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^t[13]_", "")
