"""Queries over lexicon, language-model and encoder features."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import sentiment, text
from threadlens.operators import modelfeat as mf
from threadlens.operators import sampling
from threadlens.plans import sqltext as q
from threadlens.plans.registry import query
from threadlens.plans.textual import cleaned, prepared
from threadlens.plans.threads import _rounded
from threadlens.sources import tables

# Word parts that the invented prose contains, with made-up valences.
VALENCE = {
    "the": 0.5, "of": -0.4, "and": 1.1, "ther": 2.3, "ting": -1.9, "la": 1.6, "der": -0.7,
    "und": 0.9, "is": 1.5, "to": -2.1, "en": 0.3, "re": -1.2, "que": 2.0,
}
_TOK = r"regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}'']+')"


def _tokens(c: str) -> str:
    return f"list_filter({_TOK.format(c=c)}, lambda w: w <> '')"


def _tag_sql() -> str:
    cases = " ".join(
        f"WHEN lower(t) IN {q.str_list(ws)} THEN '{tag}'" for tag, ws in lx.WORD_TAGS.items()
    )
    cases += r" WHEN regexp_matches(t, '^\p{Lu}') THEN 'NNP'"
    for suffix, tag in lx.SUFFIX_TAGS:
        cases += f" WHEN suffix(lower(t), '{suffix}') THEN '{tag}'"
    return f"CASE {cases} ELSE 'NN' END"


def _share(tags) -> str:
    return f"count(*) FILTER (tag IN {q.str_list(tags)})"


@query("pos_distribution", f"""
WITH {q.BASE}, t AS (SELECT id, unnest({_tokens('text_clean')}) AS t FROM base),
g AS (SELECT id, {_tag_sql()} AS tag FROM t), a AS (
  SELECT id, {", ".join(f"count(*) FILTER (tag = '{t}') / count(*)::DOUBLE AS pos_{t}" for t in lx.POS_TAGS)} FROM g GROUP BY id)
SELECT b.id, {", ".join(f"round(coalesce(pos_{t}, 0), 6) AS pos_{t}" for t in lx.POS_TAGS)}
FROM base b LEFT JOIN a USING (id)""")
def _(spark, d):
    return _rounded(mf.pos_distribution(cleaned(spark, d), "text_clean").drop("formality_score"))


@query("formality_score", f"""
WITH {q.BASE}, t AS (SELECT id, unnest({_tokens('text_clean')}) AS t FROM base),
g AS (SELECT id, {_tag_sql()} AS tag FROM t), a AS (
  SELECT id, {_share(lx.FORMAL_TAGS)} AS f, {_share(lx.INFORMAL_TAGS)} AS i FROM g GROUP BY id)
SELECT b.id, round(CASE WHEN coalesce(f + i, 0) = 0 THEN 0.5 ELSE f / (f + i)::DOUBLE END, 6) AS formality_score
FROM base b LEFT JOIN a USING (id)""")
def _(spark, d):
    return _rounded(mf.pos_distribution(cleaned(spark, d), "text_clean").select("id", "formality_score"))


_VALUES = ", ".join(f"({q.lit(w)}, {v})" for w, v in VALENCE.items())


@query("sentiment_scores", f"""
WITH {q.BASE}, lex(w, v) AS (VALUES {_VALUES}),
st AS (SELECT id, unnest(range(len(ss))) AS k, unnest(ss) AS s FROM base),
tk AS (SELECT id, k, unnest({_tokens('lower(s)')}) AS w FROM st),
tv AS (SELECT id, k, coalesce(v, 0)::DOUBLE AS v FROM tk LEFT JOIN lex USING (w)),
sen AS (SELECT st.id, st.k, coalesce(sum(v), 0) AS s FROM st LEFT JOIN tv USING (id, k) GROUP BY st.id, st.k),
sp AS (SELECT id, count(*) AS nsen, stddev_pop(s / sqrt(s * s + 15)) AS sd FROM sen GROUP BY id),
doc AS (
  SELECT id, sum(v) AS s, sum(v + 1) FILTER (v > 0) AS p, -sum(v - 1) FILTER (v < 0) AS n,
    count(*) FILTER (v = 0) AS u FROM tv GROUP BY id),
r AS (SELECT id, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(u, 0) AS u
  FROM base LEFT JOIN doc USING (id))
SELECT id, round(s / sqrt(s * s + 15), 6) AS sentiment_compound,
  round(coalesce(p / nullif(p + n + u, 0), 0), 6) AS sentiment_pos,
  round(coalesce(n / nullif(p + n + u, 0), 0), 6) AS sentiment_neg,
  round(coalesce(u / nullif(p + n + u, 0), 0), 6) AS sentiment_neu,
  round(CASE WHEN nsen >= 2 THEN sd ELSE 0 END, 6) AS sentiment_variability
FROM r JOIN sp USING (id)""")
def _(spark, d):
    return _rounded(mf.sentiment_scores(cleaned(spark, d), "text_clean", valence=VALENCE))


RULES = {"boosters": {"and": 0.293, "on": -0.293}, "negations": ["not", "the", "he"], "contrasts": ["in", "la"]}


@query("sentiment_rules", f"""
WITH {q.BASE}, lex(w, v) AS (VALUES {_VALUES}), bst(w, b) AS (VALUES ('and', 0.293), ('on', -0.293)),
t AS (SELECT id, text_clean, {_tokens('text_clean')} AS tok FROM base),
u AS (SELECT id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM t),
j AS (
  SELECT id, i, coalesce(v, 0)::DOUBLE AS v, coalesce(b, 0)::DOUBLE AS b, lower(x) IN ('not', 'the', 'he') AS neg,
    CASE WHEN lower(x) IN ('in', 'la') THEN i END AS turn,
    regexp_matches(x, '^[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*$') AS caps
  FROM u LEFT JOIN lex ON lex.w = lower(x) LEFT JOIN bst ON bst.w = lower(x)),
c AS (
  SELECT *, min(turn) OVER (PARTITION BY id) AS first_turn, bool_or(caps) OVER (PARTITION BY id) AND NOT bool_and(caps) OVER (PARTITION BY id) AS mixed,
    coalesce(bool_or(neg) OVER three, false) AS negated, coalesce(bool_or(b <> 0) OVER three, false) AS boosted,
    coalesce(lag(b, 1) OVER o, 0) + coalesce(lag(b, 2) OVER o, 0) * 0.95 + coalesce(lag(b, 3) OVER o, 0) * 0.9 AS boost
  FROM j WINDOW o AS (PARTITION BY id ORDER BY i), three AS (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
s AS (
  SELECT id, sum(sign(v) * (abs(v) + CASE WHEN mixed AND caps THEN 0.733 ELSE 0 END + boost) * CASE WHEN negated THEN -0.74 ELSE 1 END
      * CASE WHEN i < first_turn THEN 0.5 WHEN i > first_turn THEN 1.5 ELSE 1 END) AS s,
    count(*) FILTER (negated) AS n_negated, count(*) FILTER (boosted) AS n_boosted
  FROM c WHERE v <> 0 GROUP BY id),
r AS (SELECT id, coalesce(s, 0) + sign(coalesce(s, 0)) * least(length(text_clean) - length(replace(text_clean, '!', '')), 4) * 0.292 AS s,
    coalesce(n_negated, 0)::INTEGER AS n_negated, coalesce(n_boosted, 0)::INTEGER AS n_boosted FROM t LEFT JOIN s USING (id))
SELECT id, round(s / sqrt(s * s + 15), 6) AS sentiment_compound, n_negated, n_boosted FROM r""")
def _(spark, d):
    rated = sentiment.add_rule_sentiment(cleaned(spark, d), "text_clean", VALENCE, **RULES)
    return _rounded(rated.select("id", "sentiment_compound", "n_negated", "n_boosted"))


@query("corpus_perplexity", f"""
WITH {q.BASE}, s AS (SELECT * FROM {q.split_sql('base', 'lang')}),
lw AS (SELECT id, split, list_transform(ws, lambda x: lower(x)) AS w FROM s),
pr AS (SELECT id, split, w[i] AS a, w[i + 1] AS b FROM (
  SELECT *, unnest(range(1, len(w))) AS i FROM lw)),
ab AS (SELECT a, b, count(*) AS nab FROM pr WHERE split = 'train' GROUP BY a, b),
fa AS (SELECT a, count(*) AS na FROM pr WHERE split = 'train' GROUP BY a),
vo AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(w) AS w FROM lw WHERE split = 'train')),
sc AS (
  SELECT id, exp(-avg(ln((coalesce(nab, 0) + 0.1) / (coalesce(na, 0) + 0.1 * v)))) AS ppl
  FROM pr LEFT JOIN ab USING (a, b) LEFT JOIN fa USING (a) CROSS JOIN vo GROUP BY id)
SELECT id, split, round(ppl, 3) AS perplexity FROM s LEFT JOIN sc USING (id)""")
def _(spark, d):
    docs = sampling.stratified_split(prepared(spark, d), "lang")
    return _rounded(mf.corpus_perplexity(docs, "text_clean"), 3)


@query("token_limit_truncate", f"""
SELECT doc_id AS id, len(ws) > 300 AS truncated,
  md5(CASE WHEN len(ws) > 300 THEN array_to_string(ws[1:300], ' ') ELSE t END) AS digest
FROM (SELECT doc_id, t, {q.words('t')} AS ws FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents))""")
def _(spark, d):
    c = F.col("text")
    return tables.texts(spark, d).select(
        "id", (F.size(text.words(c)) > 300).alias("truncated"),
        F.md5(mf.token_limit_truncate(c, 300)).alias("digest"),
    )


@query("encode_tokens", f"""
WITH {q.BASE}, s AS (SELECT * FROM {q.split_sql('base', 'lang')}),
tk AS (SELECT id, split, {_tokens('lower(text_clean)')} AS w FROM s),
vo AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 3 AS tid FROM (
  SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM tk WHERE split = 'train') GROUP BY w
  ORDER BY n DESC, w LIMIT 4996)),
e AS (SELECT id, unnest(w[1:254]) AS w, unnest(range(least(len(w), 254))) AS pos FROM tk),
b AS (SELECT id, list(coalesce(tid, 1) ORDER BY pos) AS ids FROM e LEFT JOIN vo USING (w) GROUP BY id),
f AS (SELECT tk.id, list_concat([2], list_concat(coalesce(ids, []), [3])) AS ids FROM tk LEFT JOIN b USING (id))
SELECT id, array_to_string(list_concat(ids, list_transform(range(256 - len(ids)), lambda x: 0)), ' ') AS input_ids,
  len(ids)::INTEGER AS n_attended, 256::INTEGER AS n_mask FROM f""")
def _(spark, d):
    docs = sampling.stratified_split(prepared(spark, d), "lang")
    vocab = mf.build_vocabulary(docs.filter(F.col("split") == "train"), "text_clean", 5000)
    enc = mf.encode_tokens(docs, "text_clean", vocab)
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return enc.select(
        "id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        ones.alias("n_attended"), F.size("attention_mask").alias("n_mask"),
    )


def _embed_sql(source: str, words: str) -> str:
    """CTEs from ``source`` (key, ``words`` list) to ``unit`` (key, pos, x): weights of all rows, places and signs of slots."""
    return f"""
tok AS (SELECT key, ('0x' || md5(w)[1:4])::INTEGER AS slot FROM (SELECT key, unnest({words}) AS w FROM {source})),
tf AS (SELECT key, slot, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM {source}) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY slot),
val AS (SELECT key, slot::BIGINT * 40503 % 65536 * {lx.EMBEDDING_DIM} // 65536 AS pos,
  sum((1 + ln(tf)) * idf * CASE WHEN slot::BIGINT * 30011 % 65537 % 2 = 0 THEN 1 ELSE -1 END) AS x FROM tf JOIN idf USING (slot) GROUP BY 1, 2),
len AS (SELECT key, sqrt(sum(x * x)) AS len FROM val GROUP BY key),
unit AS (SELECT key, pos, (x / CASE WHEN len = 0 THEN 1 ELSE len END)::FLOAT::DOUBLE AS x FROM val JOIN len USING (key))"""


def _millionths(c: str):
    return F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), " ").alias(c)


@query("embed_texts", f"""
WITH {q.BASE}, src AS (SELECT id AS key, list_transform(ws, lambda x: lower(x)) AS w FROM base),
{_embed_sql('src', 'w')},
full_rows AS (SELECT s.key, p.p AS pos, coalesce(u.x, 0) AS x FROM src s CROSS JOIN (SELECT unnest(range(384)) AS p) p
  LEFT JOIN unit u ON u.key = s.key AND u.pos = p.p)
SELECT key AS id, string_agg(round(x * 1e6)::BIGINT::VARCHAR, ' ' ORDER BY pos) AS embedding FROM full_rows GROUP BY key""")
def _(spark, d):
    embedded = mf.embed_texts(prepared(spark, d).select("id", "text_clean"), "text_clean")
    return embedded.select("id", _millionths("embedding"))


@query("embed_long_text", f"""
WITH {q.BASE}, w AS (SELECT id, {q.words("replace(text_clean, chr(10), ' ')")} AS ws FROM base),
s AS (SELECT *, CASE WHEN len(ws) > 1000 THEN 250 ELSE greatest(len(ws), 1) END AS step FROM w),
c AS (SELECT id, ws, step, unnest(range(0, greatest(len(ws), 1), step)) AS a FROM s),
src AS (SELECT {{'id': id, 'a': a}} AS key, list_transform(ws[a + 1:a + step], lambda x: lower(x)) AS w FROM c),
{_embed_sql('src', 'w')},
n AS (SELECT key.id AS id, count(*) AS n FROM src GROUP BY 1),
mean AS (SELECT key.id AS id, pos, sum(x) AS x FROM unit GROUP BY 1, 2)
SELECT n.id, string_agg(round(coalesce(x, 0) / n * 1e6)::BIGINT::VARCHAR, ' ' ORDER BY p) AS embedding
FROM n CROSS JOIN (SELECT unnest(range(384)) AS p) LEFT JOIN mean m ON m.id = n.id AND m.pos = p GROUP BY n.id""")
def _(spark, d):
    docs = prepared(spark, d).select("id", "text_clean")
    return mf.embed_long_text(docs, "text_clean", limit=1000, size=250).select("id", _millionths("embedding"))


@query("text_chunks", f"""
WITH w AS (SELECT doc_id AS id, {q.words("replace(text, chr(10), ' ')")} AS ws FROM documents),
s AS (SELECT *, CASE WHEN len(ws) > 1000 THEN 250 ELSE greatest(len(ws), 1) END AS step FROM w),
c AS (SELECT *, unnest(range(0, greatest(len(ws), 1), step)) AS a FROM s)
SELECT id, (a // step)::INTEGER AS chunk_no, md5(array_to_string(ws[a + 1:a + step], ' ')) AS digest FROM c""")
def _(spark, d):
    chunks = mf.text_chunks(tables.texts(spark, d), "text", limit=1000, size=250)
    return chunks.select("id", "chunk_no", F.md5("chunk").alias("digest"))
