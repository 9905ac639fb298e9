"""Exact deduplication by two-pass Bloom filtering.

Pass one counts rows per filter slot and keeps the slots that at least two rows hit. Pass two probes
that filter: a row with a slot of its own cannot have a copy and passes straight through, without
being shuffled. Only the possibly repeated rows are shuffled, by the digest of their text, so a false
positive costs a little shuffle and never a wrong result.

Edge cases: null text counts as empty. Rows that repeat both id and text are one document, returned
once and counted in ``group_size``. A null id never beats another id; a group of null ids only keeps
a null id. Empty tables give empty results. Other columns of the input, whatever their names, do not
take part (``exact_groups``) or are handed through (``drop_exact_copies``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

#: Filter slots per row. The filter is broadcast, so its size is bounded: beyond the bound more rows
#: count as possibly repeated, which moves more narrow rows and changes no result.
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
#: Groups with more than one in so many rows are joined back by broadcast: there are at most so many.
HEAVY_GROUPS = 1000


def collapse_spaces(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty.

    A single space needs no replacement, so the pattern only matches runs that change.
    """
    changing = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), changing, " ")


def _slot(key: Column, probe: int, bits: int) -> Column:
    return F.xxhash64(key, F.lit(probe)).bitwiseAND(F.lit(bits - 1))


def repeat_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, bits): a bitmap of the slots that two or more rows hit; at most ``bits / 64`` rows."""
    slots = keys.select(F.explode(F.array(_slot(F.col(key), 1, bits), _slot(F.col(key), 2, bits))).alias("slot"))
    hot = slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    words = hot.groupBy(F.shiftright("slot", 6).alias("word"))
    return words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))


def mark_possible_repeats(df: DataFrame, key: str, out: str, keys: DataFrame | None = None) -> DataFrame:
    """Add boolean ``out``: false means that no other row has this ``key`` (bigint)."""
    keys = df if keys is None else keys
    wanted = max(1, keys.count()) * BITS_PER_ROW
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))
    found = F.broadcast(materialize(repeat_filter(keys, key, bits), "repeats"))
    hit = F.lit(True)
    for probe in (1, 2):
        word, mask, slot = f"__word{probe}", f"__mask{probe}", _slot(F.col(key), probe, bits)
        table = found.select(F.col("word").alias(word), F.col("bits").alias(mask))
        df = df.join(table, F.shiftright(slot, 6) == F.col(word), "left")
        bit = F.expr(f"shiftright(coalesce({mask}, 0L), cast(xxhash64({key}, {probe}) & 63 AS int)) & 1L")
        hit = hit & (bit == 1)
    return df.withColumn(out, hit).drop("__word1", "__mask1", "__word2", "__mask2")


def _split_groups(groups: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Groups above the share of 1 / HEAVY_GROUPS (broadcast, bounded in number) and the others."""
    heavy = F.col("size") * HEAVY_GROUPS > rows
    return F.broadcast(groups.filter(heavy)), groups.filter(~heavy)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per document.

    ``text_sha256`` is the digest of the text with collapsed white space. The smallest id stays.
    """
    text = collapse_spaces(F.col(text_col))
    narrow = df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    narrow = materialize(narrow.withColumn("h", F.xxhash64("sha")), "digests")
    marked = mark_possible_repeats(narrow, "h", "maybe")
    alone = marked.filter("NOT maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    maybe = marked.filter("maybe").groupBy("sha", "id").agg(F.count("*").alias("n"))
    maybe = materialize(maybe, "maybe")
    groups = maybe.groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("n").alias("size"))
    groups = materialize(groups, "groups")
    heavy, light = _split_groups(groups, narrow.count())
    cols = ["id", "sha", "keep_id", "size"]
    in_heavy = maybe.join(heavy, "sha").select(cols)
    in_light = maybe.join(heavy, "sha", "left_anti").join(light, "sha").select(cols)
    return alone.select(cols).unionAll(in_heavy).unionAll(in_light).select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without later copies; all columns are kept.

    Rows without a possible copy are not shuffled. Of the others, texts move only for rows that may
    stay: the winners are found on (digest, id) and matched on that pair, which no hot group shares.
    """
    text = collapse_spaces(F.col(text_col))
    digest = F.sha2(text, 256)
    keyed = df.select(F.struct("*").alias("row"), digest.alias("sha"), F.col(id_col).alias("id"))
    keyed = keyed.withColumn("h", F.xxhash64(F.unhex("sha")))
    narrow = materialize(keyed.select("h", "sha", "id"), "digests")
    marked = mark_possible_repeats(keyed, "h", "maybe", keys=narrow)
    alone = marked.filter("NOT maybe").select("row.*")
    pair = F.concat("sha", F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("pair")
    maybe = marked.filter("maybe").select("row", pair)
    winners = mark_possible_repeats(narrow, "h", "maybe").filter("maybe").groupBy("sha").agg(F.min("id").alias("id"))
    kept = maybe.join(winners.select(pair), "pair", "left_semi").dropDuplicates(["pair"])
    return alone.unionAll(kept.select("row.*"))
