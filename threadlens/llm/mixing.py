"""Mixing sources to target weights with a Pfair schedule.

Each source is cut into blocks of equal size. With W ticks of weight in a cycle of D slots, block j
(from 0) of a source is released at floor(j D / W) and due at ceil((j + 1) D / W); in every slot the
released block with the earliest deadline runs. All windows repeat after D slots, so the schedule of
one cycle (at most D entries, whatever the number of rows) is worked out once and every block finds
its slot by arithmetic. After every slot each lane is less than one block away from its share. The
schedule goes on when a source has run out: its slots stay empty and the others keep their ratios,
so every row is placed and none is repeated.

Sources whose share is below one tick, and null, share a lane. Its slots are the slots of a schedule of
its own, in which the same windows hold among these sources, and so on in as many levels as needed: where
no source reaches a tick, sources of similar weight form ``GROUPS`` lanes of about equal weight. The slot
of a block in one level is the number of the block in the lane of the level above.

Edge cases: rows keep all columns and repeated rows stay. A source without a weight gets the least. Null ids sort first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.ranking import position_in_group, small_side
from threadlens.session import materialize

#: Slots of a cycle: weights are met to 1 / CYCLE of a level, and a level has at most CYCLE lanes and one.
CYCLE = 1000
GROUPS = 32
#: Sum of given weights that are not whole, after scaling.
WEIGHT_SUM = 10**12
BLOCK_ROWS = 64
#: Rows that one task ranks together, on average.
BUCKET_ROWS = 2000


def temper_weights(df: DataFrame, source_col: str, power: float = 0.5) -> DataFrame:
    """(source, weight): row counts raised to ``power``, which lifts small sources."""
    n = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    return n.select("source", F.floor(F.pow("n", F.lit(power)) * 1000).alias("weight"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _ticks(members: DataFrame, cycle: int) -> DataFrame:
    """(node, lane, ticks) of (node, lane, weight, total): whole ticks that add up to ``cycle`` in a node, by largest remainder."""
    base = members.groupBy("node", "lane").agg(F.sum("weight").alias("weight"), F.max("total").alias("total"))
    base = base.withColumn("base", F.greatest(F.expr(f"(weight * {cycle}) div total"), F.lit(1)))
    base = base.withColumn("rest", F.expr(f"weight * {cycle} - base * total"))
    # At most CYCLE + 1 rows a node. A pooled lane has one tick at least, so a tick may be missing.
    node = Window.partitionBy("node")
    rank = F.row_number().over(node.orderBy(F.desc("rest"), "lane"))
    back = F.row_number().over(node.orderBy(F.desc("base"), "lane"))
    left = F.lit(cycle) - F.sum("base").over(node)
    ticks = F.col("base") + F.when((left > 0) & (rank <= left), 1).when((left < 0) & (back == 1), left).otherwise(0)
    return base.select("node", "lane", ticks.cast("long").alias("ticks"))


def lanes(weights: DataFrame, cycle: int = CYCLE) -> tuple[DataFrame, int]:
    """(node, lane, ticks) of all levels, and the number of levels.

    The first level is the node with the empty name. A lane is ``=`` and a source, the empty text for the null
    source, or the name of the node whose schedule fills its slots, which begins with a slash.
    """
    left = weights.groupBy(_key(F.col("source")).alias("key")).agg(F.sum("weight").cast("long").alias("weight"))
    left = materialize(left.select(F.lit("").alias("node"), "key", "weight"), "sources")
    plan, levels = None, 0
    while plan is None or not left.isEmpty():
        own = F.col("weight") * cycle >= F.col("total")
        if not levels:
            own = own & (F.col("key") != "")
        totals = left.groupBy("node").agg(F.greatest(F.sum("weight"), F.lit(1)).alias("total"))
        marked = left.join(totals, "node").withColumn("own", own)
        some = marked.groupBy("node").agg(F.max("own").alias("some"))
        marked = materialize(marked.join(some, "node"), "marked")
        alone = marked.filter("own").select("node", "key", F.col("key").alias("lane"), "weight", "total")
        pool = marked.filter("some AND NOT own").select(
            "node", "key", F.concat("node", F.lit("/p")).alias("lane"), "weight", "total")
        split = marked.filter("NOT some")
        before = F.sum("weight").over(Window.partitionBy("node").orderBy(F.desc("weight"), "key")) - F.col("weight")
        number = F.least((F.floor(before / F.col("total") * GROUPS)), F.lit(GROUPS - 1)).cast("string")
        if not levels:  # nothing but null and sources without a weight, or very many sources
            number = F.when(F.col("key") == "", "p").otherwise(number)
        split = split.select("node", "key", F.concat("node", F.lit("/"), number).alias("lane"), "weight", "total")
        members = materialize(alone.unionAll(pool).unionAll(split), "lanes")
        ticks = _ticks(members, cycle)
        plan = ticks if plan is None else plan.unionAll(ticks)
        left = members.filter("key <> lane").select(
            F.col("lane").alias("node"), "key", F.greatest("weight", F.lit(1)).alias("weight"))
        left, levels = materialize(left, "sources"), levels + 1
    return plan, levels


def cycle_slots(lane_ticks: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(node, lane, ticks, slots): for each lane the slots of its blocks within one cycle of its node.

    Earliest deadline first over unit slots; ties go to the first lane by name.
    """
    one = lane_ticks.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lane", "ticks"))).alias("l"))
    one = one.select("node", "l", F.expr("transform(l, x -> x.ticks)").alias("w"))
    due = (
        f"transform(w, (x, i) -> CASE WHEN s.done[i] < x AND s.done[i] * {cycle} < t * x"
        f" THEN struct(((s.done[i] + 1) * {cycle} + x - 1) div x AS due, i AS i) END)"
    )
    picked = one.select("node", "l", F.expr(f"""
        aggregate(sequence(1, {cycle}),
            struct(transform(w, x -> 0L) AS done, cast(array() AS array<int>) AS pick),
            (s, t) -> transform(array(array_min({due}).i), p -> struct(
                transform(s.done, (d, i) -> d + IF(i = p, 1L, 0L)) AS done,
                concat(s.pick, array(p)) AS pick))[0],
            s -> s.pick)""").alias("pick"))
    slots = F.expr("filter(transform(pick, (p, t) -> IF(p = i, t, -1)), t -> t >= 0)")
    return picked.select("node", F.posexplode("l").alias("i", "x"), "pick").select("node", "x.lane", "x.ticks", slots.alias("slots"))


def _hash_order(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")))


def mix(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS, cycle: int = CYCLE,
) -> DataFrame:
    """``row`` (struct of all columns) with lane, block, release_slot, deadline_slot, slot, mix_order.

    ``weights`` has (source, weight); without it the square root of the row counts is used. Within
    a source, rows come in the order of a hash of the id. ``mix_order`` sorts the whole mix.
    """
    if weights is None:
        weights = temper_weights(df, source_col)
    else:
        if dict(weights.dtypes)["weight"] not in ("tinyint", "smallint", "int", "bigint"):
            scale = F.lit(WEIGHT_SUM / (weights.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 1.0))
            whole = F.greatest(F.round(F.col("weight").cast("double") * scale), F.signum(F.col("weight").cast("double")))
            weights = weights.withColumn("weight", whole)
        present = df.select(F.col(source_col).alias("source")).distinct()
        absent = present.join(weights, present["source"].eqNullSafe(weights["source"]), "left_anti")
        weights = weights.select("source", F.col("weight").cast("long")).unionByName(
            absent.select("source", F.lit(0).cast("long").alias("weight")))
    ticks, levels = lanes(weights, cycle)
    plan = materialize(cycle_slots(ticks, cycle), "lanes")
    buckets = 1 << max(0, (df.count() // BUCKET_ROWS).bit_length())
    rows = df.select(F.struct("*").alias("row"), _key(F.col(source_col)).alias("lane"), _hash_order(F.col(id_col)).alias("o"))
    bucket = F.expr(f"cast(conv(substr(o, 1, 8), 16, 10) AS bigint) * {buckets} div 4294967296")
    rows = rows.select("row", "lane", "o", F.col("row").getField(id_col).alias("id"))
    ranked = position_in_group(rows, ["lane"], ["o", "id"], bucket, "pos")
    placed = ranked.join(small_side(plan.filter("lane NOT LIKE '/%'"), "leaves"), "lane")
    placed = placed.withColumn("block", F.expr(f"(pos - 1) div {block_rows}"))
    slot = F.expr(f"(block div ticks) * {cycle} + slots[cast(block % ticks AS int)]")
    placed = placed.withColumn("slot", slot).select("row", "lane", "pos", "node", "ticks", "block", "slot")
    above = plan.filter("lane LIKE '/%'").select(
        F.col("node").alias("up"), F.col("lane").alias("node"), F.col("ticks").alias("t"), F.col("slots").alias("s"))
    for _ in range(levels - 1):  # the first level has the node without a name, which nothing is above
        next_slot = F.expr(f"(slot div t) * {cycle} + s[cast(slot % t AS int)]")
        placed = placed.join(small_side(above, "above"), "node", "left").select(
            "row", "lane", "pos", F.coalesce("up", "node").alias("node"), F.coalesce("t", "ticks").alias("ticks"),
            F.when(F.col("t").isNull(), F.col("block")).otherwise(F.col("slot")).alias("block"),
            F.coalesce(next_slot, "slot").alias("slot"),
        )
    own = F.broadcast(plan.filter("node = '' AND lane LIKE '=%'").select("lane", F.expr("substr(lane, 2)").alias("name")))
    return placed.join(own, "lane", "left").select(
        "row", F.col("name").alias("lane"), "block",
        F.expr(f"(block * {cycle}) div ticks").alias("release_slot"),
        F.expr(f"((block + 1) * {cycle} + ticks - 1) div ticks").alias("deadline_slot"), "slot",
        F.expr(f"slot * {block_rows} + (pos - 1) % {block_rows}").alias("mix_order"),
    )


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """All columns of the input, sorted over all partitions in the order of the mix."""
    return mixed.orderBy("mix_order").select("row.*")
