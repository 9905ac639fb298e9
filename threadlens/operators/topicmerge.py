"""Topics in any number: density clusters of the vectors, merged while their words are alike.

Topics are compared by the cosine of their class TF-IDF vectors, term by term, without hashed slots. Vectors of length one whose
cosine reaches ``at`` share a term among those each holds before the rest of its length falls below ``at``, terms taken rarest
first in one order for all. Only such pairs are compared, so common words never bring topics together, and no pair is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.hierarchy import density_hierarchy
from threadlens.operators.neighbours import connected_components
from threadlens.operators.ranking import small_side
from threadlens.operators.topics import class_weight, term_counts
from threadlens.session import materialize

_SLACK = 1e-9


def unit_terms(counts: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Class TF-IDF of each topic scaled to length one, and in how many topics each term is: (topic, term, topics, u).

    Uses and topics of a term are counted where its rows meet, in one exchange of the counts.
    """
    totals = small_side(counts.groupBy(topic).agg(F.sum("n").alias("total")), "topic-totals")
    mean_size = totals.agg(F.avg("total").alias("a")).scalar()
    same_term = Window.partitionBy("term")
    spread = counts.select(topic, "term", "n", F.sum("n").over(same_term).alias("f"), F.count("*").over(same_term).alias("topics"))
    weights = spread.join(totals, topic).select(topic, "term", "topics", class_weight(mean_size).alias("weight"))
    weights = materialize(weights, "class-weights")
    length = weights.groupBy(topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    length = small_side(length, "lengths")  # one row a topic; the scaled terms are not written a second time
    return weights.join(length, topic).select(topic, "term", "topics", (F.col("weight") / F.col("length")).alias("u"))


def leading_terms(units: DataFrame, at: float, topic: str = "topic_id", alone: DataFrame | None = None) -> DataFrame:
    """The terms of each topic, rarest first, up to where the rest is shorter than ``at``: (topic, term).

    ``alone`` has the squared length of a topic's terms that come before those in ``units``.
    """
    earlier = Window.partitionBy(topic).orderBy("topics", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("u") * F.col("u")).over(earlier), F.lit(0.0))
    ordered = units.withColumn("before", before)
    if alone is not None:
        ordered = ordered.join(alone, topic, "left").withColumn("before", F.col("before") + F.coalesce("alone", F.lit(0.0)))
    return ordered.filter(1.0 - F.col("before") >= at * at - _SLACK).select(topic, "term")


def similar_topics(counts: DataFrame, at: float, topic: str = "topic_id") -> DataFrame:
    """Pairs (a, b, cosine) with a < b whose cosine, rounded to nine digits, is ``at`` or more, 0 < at <= 1.

    A term of one topic is in no pair: it adds to the length of that topic and is not moved again.
    """
    units = unit_terms(counts, topic)
    alone = units.filter("topics = 1").groupBy(topic).agg(F.sum(F.col("u") * F.col("u")).alias("alone"))
    units = units.filter("topics > 1")
    lead = materialize(leading_terms(units, at, topic, small_side(alone, "alone")), "leading-terms")
    pairs = lead.select(F.col(topic).alias("a"), "term").join(lead.select(F.col(topic).alias("b"), "term"), "term").filter(
        "a < b").select("a", "b").distinct()
    pairs = small_side(pairs, "candidates")
    left = units.select(F.col(topic).alias("a"), "term", F.col("u").alias("ua"))
    right = units.select(F.col(topic).alias("b"), "term", F.col("u").alias("ub"))
    # Either all terms of the first topic of each pair look for the second, or topics meet at their terms: whichever is less.
    sizes = units.groupBy(F.col(topic).alias("a")).agg(F.count("*").alias("size"))
    by_pair = pairs.join(sizes, "a").agg(F.sum("size")).first()[0] or 0
    by_term = units.agg(F.sum("topics")).first()[0] or 0
    if by_term < by_pair:
        met = left.join(right, "term").filter("a < b").join(pairs, ["a", "b"], "left_semi")
    else:
        met = pairs.join(left, "a").join(right, ["b", "term"])
    cosine = met.groupBy("a", "b").agg(F.round(F.sum(F.col("ua") * F.col("ub")), 9).alias("cosine"))
    return cosine.filter(F.col("cosine") >= at)


def merge_topics(counts: DataFrame, at: float, topic: str = "topic_id", rounds: int | None = None) -> DataFrame:
    """(topic, merged): the least topic of the group each ends in.

    A round joins all topics that chains of alike topics connect, adds up their counts and weighs the terms anew. Rounds end when
    no two topics are alike, or after ``rounds``. Topics without any term stay alone; they are not in ``counts`` and not returned.
    """
    now = materialize(counts.select(topic, "term", "n"), "topic-counts")
    found = materialize(now.select(topic).distinct().withColumn("merged", F.col(topic)), "merged")
    done = 0
    while rounds is None or done < rounds:
        pairs = materialize(similar_topics(now, at, topic), "alike")
        if not pairs.limit(1).count():
            break
        joined = materialize(connected_components(pairs).withColumnRenamed("node", "merged"), "joined")
        found = materialize(found.join(joined, "merged", "left").select(
            topic, F.coalesce("label", "merged").alias("merged")), "merged")
        moved = now.join(joined.withColumnRenamed("merged", topic), topic, "left")
        now = materialize(moved.groupBy(F.coalesce("label", topic).alias(topic), "term").agg(
            F.sum("n").alias("n")), "topic-counts")
        done += 1
    return found


def density_topics(
    train: DataFrame, text_col: str, id_col: str = "id", vec: str = "embedding", min_points: int = 5,
    min_topic_size: int = 10, merge_at: float = 0.9, **blocks,
) -> DataFrame:
    """``train`` with ``topic_id``: the least id of the topic, -1 for texts in none.

    Neither the number of topics nor a radius is chosen. Ids are unique and not null.
    """
    clusters = density_hierarchy(train, min_points, min_topic_size, id_col, vec, **blocks).select(
        F.col("id").alias(id_col), F.col("cluster_id").alias("topic_id"))
    placed = materialize(train.drop("topic_id").join(clusters, id_col), "placed-texts")
    merged = merge_topics(term_counts(placed.filter(F.col("topic_id") != -1), text_col), merge_at)
    return placed.join(merged, "topic_id", "left").withColumn(
        "topic_id", F.coalesce("merged", "topic_id")).select(*train.drop("topic_id").columns, "topic_id")
