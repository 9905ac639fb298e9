"""The registered queries of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (
    bpe, exact_dedup, fingerprints, hard_negatives, langid, lm_score, mixing, near_dedup, quality, suffix_dedup, token_alignment,
    token_counts, toxicity,
)

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(fn: Run) -> Run:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXING_SQL = f"""
WITH RECURSIVE n AS (
    SELECT source, CAST(floor(pow(count(*), 0.5) * 1000) AS BIGINT) AS weight FROM documents GROUP BY source),
total AS (SELECT greatest(sum(weight), 1) AS total FROM n),
pooled AS (
    SELECT CASE WHEN weight * {mixing.CYCLE} >= total THEN source END AS lane, sum(weight) AS weight, max(total) AS total
    FROM n, total GROUP BY 1),
based AS (SELECT lane, weight, total, greatest(weight * {mixing.CYCLE} // total, 1) AS base FROM pooled),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY weight * {mixing.CYCLE} - base * total DESC, lane NULLS FIRST) AS up,
        row_number() OVER (ORDER BY base DESC, lane NULLS FIRST) AS down, {mixing.CYCLE} - sum(base) OVER () AS missing
    FROM based),
lanes AS (
    SELECT lane, CAST(base + CASE WHEN missing > 0 AND up <= missing THEN 1 WHEN missing < 0 AND down = 1 THEN missing
        ELSE 0 END AS BIGINT) AS ticks, row_number() OVER (ORDER BY lane NULLS FIRST) AS i
    FROM ranked),
w AS (SELECT list(ticks ORDER BY i) AS w FROM lanes),
steps AS (
    SELECT 0 AS t, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM w
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p
    FROM (
        SELECT t, done, list_min(list_filter(list_transform(w, lambda x, i: CASE
            WHEN done[i] < x AND done[i] * {mixing.CYCLE} < (t + 1) * x
            THEN ((done[i] + 1) * {mixing.CYCLE} + x - 1) // x * 100000 + i END), lambda k: k IS NOT NULL)) % 100000 AS p
        FROM steps, w WHERE t < {mixing.CYCLE})),
slots AS (
    SELECT lane, ticks, t - 1 AS spot, row_number() OVER (PARTITION BY lane ORDER BY t) - 1 AS k
    FROM steps JOIN lanes ON pick = i WHERE t > 0),
placed AS (
    SELECT doc_id, source, l.lane, ticks, row_number() OVER (
        PARTITION BY l.lane ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS pos
    FROM documents d JOIN lanes l ON l.lane IS NOT DISTINCT FROM
        CASE WHEN d.source IN (SELECT lane FROM lanes WHERE lane IS NOT NULL) THEN d.source END)
SELECT doc_id, source, p.lane, pos // {mixing.BLOCK_ROWS} AS block,
    pos // {mixing.BLOCK_ROWS} * {mixing.CYCLE} // p.ticks AS release_slot,
    ((pos // {mixing.BLOCK_ROWS} + 1) * {mixing.CYCLE} + p.ticks - 1) // p.ticks AS deadline_slot,
    pos // {mixing.BLOCK_ROWS} // p.ticks * {mixing.CYCLE} + spot AS slot,
    (pos // {mixing.BLOCK_ROWS} // p.ticks * {mixing.CYCLE} + spot) * {mixing.BLOCK_ROWS} + pos % {mixing.BLOCK_ROWS} AS mix_order
FROM placed p JOIN slots s ON s.lane IS NOT DISTINCT FROM p.lane AND k = pos // {mixing.BLOCK_ROWS} % p.ticks
"""


@_query("op1_mixing", MIXING_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mix whose source weights grow with the root of the source's size."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("row.doc_id", "row.source", "lane", "block", "release_slot", "deadline_slot", "slot", "mix_order")


@_query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


EXACT_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
    sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


@_query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def _fold(parts: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(0))


@_query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 0 of 5 is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _fold(5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


LM_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
x AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT a.k, a.w AS v, b.w AS w FROM x a JOIN x b ON a.k = b.k AND b.i = a.i + 1),
own AS (SELECT k, w, count(*) AS n FROM x GROUP BY k, w),
uni AS (SELECT w, sum(n) AS n FROM own GROUP BY w),
rest AS (SELECT own.k, own.w, greatest(uni.n - own.n, 1) AS n FROM own JOIN uni USING (w)),
mine AS (SELECT k, v, w, count(*) AS c FROM p GROUP BY k, v, w),
duo AS (SELECT v, w, sum(c) AS n FROM mine GROUP BY v, w),
others AS (SELECT k, greatest((SELECT sum(n) FROM uni) - len(w), 1) AS n FROM d),
s AS (
    SELECT k, c * CASE WHEN duo.n > c THEN ln(duo.n - c) - ln(a.n) ELSE ln(0.4) + ln(b.n) - ln(others.n) END AS s
    FROM mine JOIN duo USING (v, w) JOIN rest a USING (k) JOIN rest b USING (k) JOIN others USING (k)
    WHERE a.w = mine.v AND b.w = mine.w
    UNION ALL
    SELECT k, ln(rest.n) - ln(others.n) FROM x JOIN rest USING (k, w) JOIN others USING (k) WHERE i = 1),
t AS (SELECT k, sum(s) AS s FROM s GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(t.s / len(w), 6) AS mean_log_score
FROM d LEFT JOIN t USING (k)
"""


@_query("op5_lm_score", LM_SQL)
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document under the word and pair counts of all other documents."""
    scored = lm_score.score_corpus(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


@_query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 1 of 3 is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _fold(3) == 1
    model = langid.fit(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 0 of 5 of the labels is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(_fold(5) != 0))
    graded = docs.select("doc_id", toxicity.grade(docs, model).alias("g")).select("doc_id", "g.*")
    return graded.withColumn("toxic", F.col("p_toxic") >= 0.5)


@_query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without byte strings that repeat anywhere."""
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    docs = _table(spark, sf_dir, "documents")
    return near_dedup.near_classes(docs).select("doc_id", "class_id", "class_size", "kept")


@_query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every whole text, and of the bytes decoded from them."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NEGATIVES_SQL = """
WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@_query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved on by one."""
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked tokens of two tokenizers in every document, weighed by the documents that hold the same links."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.with_alignment(docs, *paths).drop("text")


@_query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document, and whether it exceeds a context of 512."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"))
