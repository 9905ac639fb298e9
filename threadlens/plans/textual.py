"""Queries over the scalar text, date and number features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import scalars, text
from threadlens.operators import textfeat
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.session import materialize
from threadlens.sources import tables
from threadlens.sources.files import spread

# Phrases and words that the invented prose contains, so the checks are not vacuous.
PHRASES = ["the of", "of the", "in", "and the", "it is", "on the", "la", "der"]
STOP = lx.STOPWORDS
FIRST = ["the", "la", "i", "me", "er", "ich", "re"]


def cleaned(spark, d) -> DataFrame:
    """Cleaned documents of at least five characters."""
    docs = spread(tables.texts(spark, d).select("id", "community", "lang", "text"), "id")
    # The partition id is not deterministic, which keeps the optimizer from moving the filter, and
    # with it the cleaning, below the repartition and into the few scan tasks.
    docs = docs.withColumns({
        "text_clean": text.clean_text(F.col("text")), "__part": F.spark_partition_id()
    })
    docs = docs.filter((F.length("text_clean") >= 5) & (F.col("__part") >= 0))
    return docs.select("id", "community", "lang", "text_clean")


def prepared(spark, d) -> DataFrame:
    """The cleaned documents written once, for work that passes over them several times."""
    return materialize(cleaned(spark, d), "cleaned")


def _r(cols: dict, digits: int = 6) -> list:
    return [F.round(c, digits).alias(k) for k, c in cols.items()]


def _features(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("id", *[
        F.round(n, digits).alias(n) if kinds[n] == "double" else F.col(n) for n in names
    ])


@query("clean_text", f"""
SELECT page_id, length(t)::BIGINT AS n_clean, md5(t) AS digest
FROM (SELECT page_id, {q.clean('html')} AS t FROM pages)
UNION ALL
SELECT 1000000 + doc_id, length(t)::BIGINT, md5(t)
FROM (SELECT doc_id, {q.clean('text')} AS t FROM documents)""")
def _(spark, d):
    pages = tables.table(spark, d, "pages").select("page_id", F.col("html").alias("raw"))
    docs = tables.table(spark, d, "documents").select(
        (F.col("doc_id") + 1000000).alias("page_id"), F.col("text").alias("raw")
    )
    raw = spread(pages.unionByName(docs), "page_id")
    t = raw.withColumn("t", text.clean_text(F.col("raw")))
    return t.select(
        "page_id", F.length("t").cast("long").alias("n_clean"), F.md5("t").alias("digest")
    )


@query("length_features", f"""
WITH {q.BASE}, s AS (
  SELECT id, list_transform(ss, lambda x: len({q.words('x')})) AS sl FROM base
), sd AS (
  SELECT id, stddev_pop(v) AS sd, count(*) AS n FROM (SELECT id, unnest(sl) AS v FROM s) GROUP BY id
)
SELECT b.id, length(text_clean)::BIGINT AS char_count, len(ws)::BIGINT AS word_count,
  len(ss)::BIGINT AS sentence_count,
  round(list_sum(list_transform(ws, lambda w: length(w))) / len(ws)::DOUBLE, 6) AS avg_word_length,
  round(len(ws) / len(ss)::DOUBLE, 6) AS avg_sentence_length,
  round(CASE WHEN sd.n > 1 THEN sd.sd ELSE 0 END, 6) AS sentence_length_std,
  len(list_filter(string_split(text_clean, chr(10)), lambda p: regexp_matches(p, '[^{q.WS}]')))::BIGINT
    AS paragraph_count
FROM base b JOIN sd USING (id)""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["length"])
    return _features(df, textfeat.FAMILY_COLUMNS["length"])


@query("readability", f"""
WITH {q.BASE}, w AS (
  SELECT id, lower(unnest(ws)) AS w FROM base
), syl AS (
  SELECT id, sum(n) AS syl, count(*) FILTER (n >= 3) AS hard FROM (
    SELECT id, greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))
      - CASE WHEN regexp_matches(w, '{q.SILENT}') THEN 1 ELSE 0 END) AS n
    FROM w) GROUP BY id
), k AS (
  SELECT b.id, len(ws)::DOUBLE AS w, len(ss)::DOUBLE AS s, syl, hard,
    {q.count_class('text_clean', '[\\p{L}]')} AS letters,
    list_sum(list_transform(ws, lambda x: length(x))) AS chars
  FROM base b JOIN syl USING (id)
)
SELECT id, round(0.39 * (w / s) + 11.8 * (syl / w) - 15.59, 6) AS flesch_kincaid,
  round(0.4 * (w / s + 100 * hard / w), 6) AS gunning_fog,
  round(0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8, 6) AS coleman_liau,
  round(4.71 * (chars / w) + 0.5 * (w / s) - 21.43, 6) AS automated_readability
FROM k""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["readability"])
    return _features(df, textfeat.FAMILY_COLUMNS["readability"])


@query("vocab_richness", f"""
WITH {q.BASE}, f AS (
  SELECT id, w, count(*) AS n FROM (SELECT id, lower(unnest(ws)) AS w FROM base)
  WHERE regexp_matches(w, '^\\p{{L}}+$') GROUP BY id, w
), a AS (
  SELECT id, count(*) / sum(n)::DOUBLE AS ttr, count(*) FILTER (n = 1) / sum(n)::DOUBLE AS hapax
  FROM f GROUP BY id
)
SELECT b.id, round(coalesce(ttr, 0), 6) AS ttr, round(coalesce(hapax, 0), 6) AS hapax_ratio
FROM base b LEFT JOIN a USING (id)""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["vocab"])
    return _features(df, textfeat.FAMILY_COLUMNS["vocab"])


@query("stopword_ratio", f"""
WITH {q.BASE}
SELECT id, round(coalesce(len(list_filter(ws, lambda w: lower(w) IN {q.str_list(STOP)}))
  / nullif(len(ws), 0)::DOUBLE, 0), 6) AS stopword_ratio FROM base""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["stopword"])
    return _features(df, ["stopword_ratio"])


@query("punctuation_density", f"""
WITH {q.BASE}
SELECT id, round({q.count_class('text_clean', q.PUNCT)} / length(text_clean)::DOUBLE, 6)
  AS punctuation_density FROM base""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["punctuation"])
    return _features(df, ["punctuation_density"])


@query("special_punct", f"""
WITH t AS (
  SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT 1000000 + page_id, html FROM pages
)
SELECT id, len(regexp_extract_all(text, '!'))::BIGINT AS exclamation_count,
  len(regexp_extract_all(text, '\\?'))::BIGINT AS question_count,
  len(regexp_extract_all(text, '\\.\\.\\.'))::BIGINT AS ellipsis_count,
  len(regexp_extract_all(text, '{text.ASTRAL_CLASS}'))::BIGINT AS emoji_count
FROM t""")
def _(spark, d):
    docs = tables.texts(spark, d).select("id", "text")
    pages = tables.table(spark, d, "pages").select(
        (F.col("page_id") + 1000000).alias("id"), F.col("html").alias("text")
    )
    t = docs.unionByName(pages)
    return t.select("id", *[c.alias(k) for k, c in text.special_punct(F.col("text")).items()])


def _ngram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
    SELECT id, count(*) FILTER (c > 1) / count(*)::DOUBLE AS r FROM (
      SELECT id, g, count(*) AS c FROM (
        SELECT id, {gram} AS g FROM (
          SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM lw WHERE len(w) >= {n}))
      GROUP BY id, g) GROUP BY id"""


@query("ngram_repetition", f"""
WITH {q.BASE}, lw AS (SELECT id, list_transform(ws, lambda x: lower(x)) AS w FROM base),
t AS ({_ngram_sql(3)}), f AS ({_ngram_sql(4)})
SELECT b.id, round(coalesce(t.r, 0), 6) AS trigram_repeat_rate,
  round(coalesce(f.r, 0), 6) AS fourgram_repeat_rate
FROM base b LEFT JOIN t USING (id) LEFT JOIN f USING (id)""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["ngram"])
    return _features(df, textfeat.FAMILY_COLUMNS["ngram"])


def hedging_sql(c: str, n_words: str, phrases) -> str:
    hits = " + ".join(
        f"(length(lower({c})) - length(replace(lower({c}), {q.lit(p)}, ''))) / {len(p)}.0"
        for p in phrases
    )
    return f"coalesce(({hits}) * 100 / nullif({n_words}, 0), 0)"


@query("hedging_rate", f"""
WITH {q.BASE}
SELECT id, round({hedging_sql('text_clean', 'len(ws)', PHRASES)}, 6) AS hedging_per_100w,
  round({hedging_sql('text_clean', 'len(ws)', lx.HEDGING_PHRASES)}, 6) AS hedging_default
FROM base""")
def _(spark, d):
    df = cleaned(spark, d).select(
        "id", F.lower("text_clean").alias("low"), F.size(text.words(F.col("text_clean"))).alias("n")
    )
    return df.select("id", *_r({
        "hedging_per_100w": text.hedging_rate(F.col("low"), F.col("n"), PHRASES),
        "hedging_default": text.hedging_rate(F.col("low"), F.col("n")),
    }))


@query("self_reference_rate", f"""
WITH {q.BASE}
SELECT id, round(coalesce(len(list_filter(ws, lambda w: lower(w) IN {q.str_list(FIRST)}))
  / nullif(len(ws), 0)::DOUBLE, 0), 6) AS self_reference_rate FROM base""")
def _(spark, d):
    df = cleaned(spark, d).withColumn("lowered", text.words(F.lower("text_clean")))
    return df.select(
        "id", *_r({"self_reference_rate": text.self_reference_rate(F.col("lowered"), FIRST)})
    )


@query("burstiness", f"""
WITH {q.BASE}, s AS (
  SELECT id, stddev_pop(v) / avg(v) AS b, count(*) AS n, avg(v) AS m FROM (
    SELECT id, unnest(list_transform(ss, lambda x: len({q.words('x')}))) AS v FROM base) GROUP BY id
)
SELECT b.id, round(CASE WHEN s.n >= 2 AND s.m > 0 THEN s.b ELSE 0 END, 6) AS burstiness
FROM base b LEFT JOIN s USING (id)""")
def _(spark, d):
    df = textfeat.add_features(cleaned(spark, d), "text_clean", ["burstiness"])
    return _features(df, ["burstiness"])


@query("epoch_to_timestamp", """
SELECT event_id, (epoch_us(ts) // 1000000)::BIGINT AS created_utc,
  strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created
FROM events""")
def _(spark, d):
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    ev = tables.table(spark, d, "events").select("event_id", sec.alias("created_utc"))
    return ev.withColumn("created", F.date_format(
        scalars.epoch_to_timestamp(F.col("created_utc")), "yyyy-MM-dd HH:mm:ss"
    ))


@query("parse_mixed_timestamp", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
    ELSE epoch_us(date_trunc('second', ts))::BIGINT END AS micros
FROM events""")
def _(spark, d):
    # The same instants written as epoch seconds, epoch milliseconds, ISO text and junk.
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    sec = F.unix_seconds(ts)
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, sec.cast("string")).when(kind == 1, (sec * 1000).cast("string"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .otherwise(F.col("event_type"))
    )
    ev = tables.table(spark, d, "events").select("event_id", raw.alias("raw"))
    parsed = scalars.parse_mixed_timestamp(F.col("raw"))
    return ev.select("event_id", F.unix_micros(parsed).alias("micros"))


@query("calendar_features", """
SELECT event_id, hour(ts)::INTEGER AS hour_of_day, (isodow(ts) - 1)::INTEGER AS day_of_week
FROM events""")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    return ev.select(
        "event_id", *[c.alias(k) for k, c in scalars.calendar_features(F.col("ts")).items()]
    )


@query("coerce_numeric", """
SELECT event_id, coalesce(try_cast(raw AS DOUBLE), 0) AS upvotes FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE value::VARCHAR END AS raw
  FROM events)""")
def _(spark, d):
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.col("value").cast("string")
    )
    ev = tables.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return ev.select("event_id", scalars.coerce_numeric(F.col("raw")).alias("upvotes"))


@query("truncate_text", """
SELECT doc_id AS id, md5(text[1:512]) AS head_512,
  CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview
FROM documents""")
def _(spark, d):
    c = F.col("text")
    return tables.texts(spark, d).select(
        "id", F.md5(text.truncate_text(c, 512)).alias("head_512"),
        text.truncate_text(c, 100, ellipsis=True).alias("preview"),
    )


@query("normalize_newlines", """
SELECT doc_id AS id, md5(replace(text, chr(10), ' ')) AS digest FROM documents""")
def _(spark, d):
    return tables.texts(spark, d).select(
        "id", F.md5(text.normalize_newlines(F.col("text"))).alias("digest")
    )


@query("phase_bin", """
SELECT vec_id, bin AS phase_bin, 'PHASE_' || lpad(bin::VARCHAR, 2, '0') AS phase FROM (
  SELECT vec_id, greatest(0, least(11, floor(
    (atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) + pi()) / (2 * pi()) * 12)))::INTEGER AS bin
  FROM embeddings)""")
def _(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    bins = tables.table(spark, d, "embeddings").select(
        "vec_id", scalars.phase_bin(x, y).alias("phase_bin")
    )
    return bins.withColumn("phase", scalars.phase_label(F.col("phase_bin")))
