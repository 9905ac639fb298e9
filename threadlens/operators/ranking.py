"""Ranking without large groups.

A plain ``row_number`` over a class, a community or an author sends that whole group to one task. The
operators here count per bucket first, so a single task only ever ranks one bucket, and whole rows
are not shuffled where a threshold is enough to pick them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.scalars import hash_order
from threadlens.session import materialize

BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, name: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a pre-aggregated table once and hint a broadcast only if its counted size allows.

    Above ``max_rows`` the table is returned without a hint and joins by shuffle.
    """
    table = materialize(df, name)
    return F.broadcast(table) if table.count() <= max_rows else table


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; the keys of ``left`` stay."""
    named = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"__right_{k}" for k in keys])


def _running_before(keys: list[str], bucket: str, count: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def hash_cuts(
    df: DataFrame, groups: list[str], id_col: str, seed: int,
    targets: Callable[[Column], dict[str, Column]], bucket_digits: int = 4,
) -> DataFrame:
    """Per group, the (hash, id) of the row at each wanted rank of the hash order.

    ``targets`` maps the group size to named ranks. Buckets are the leading hex digits of the hash:
    counting them locates each rank, and only the one bucket that holds it is ranked row by row.
    """
    base = df.select(
        *groups, F.col(id_col).alias("__id"), hash_order(F.col(id_col), seed).alias("__k")
    ).withColumn("__b", F.substring("__k", 1, bucket_digits))
    hist = base.groupBy(*groups, "__b").agg(F.count("*").alias("__c"))
    hist = hist.withColumn("__before", _running_before(groups, "__b", "__c")).withColumn(
        "__n", F.sum("__c").over(Window.partitionBy(*groups))
    )
    wanted = targets(F.col("__n"))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), t.cast("long").alias("rank"))
        for name, t in wanted.items()
    ])
    hit = hist.withColumn("__t", F.explode(ranks)).filter(
        (F.col("__before") < F.col("__t.rank"))
        & (F.col("__t.rank") <= F.col("__before") + F.col("__c"))
    )
    hit = hit.select(
        *groups, "__b", F.col("__t.name").alias("__name"),
        (F.col("__t.rank") - F.col("__before")).alias("__want"),
    )
    in_bucket = Window.partitionBy(*groups, "__b", "__name").orderBy("__k", "__id")
    found = (
        null_safe_join(base, small_side(hit, "ranks"), [*groups, "__b"])
        .withColumn("__rn", F.row_number().over(in_bucket))
        .filter(F.col("__rn") == F.col("__want"))
    )
    at = F.struct(F.col("__k"), F.col("__id"))
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("__name") == name, at)).alias(name) for name in wanted]
    )


def hash_key(id_col: str, seed: int) -> Column:
    """The value that ``hash_cuts`` thresholds are compared with."""
    return F.struct(hash_order(F.col(id_col), seed).alias("__k"), F.col(id_col).alias("__id"))


def position_in_group(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "position"
) -> DataFrame:
    """1-based rank in the group; ``bucket`` must not decrease along the order.

    Group and bucket form one struct, which is never null: rows with a null key or bucket stay, and the
    join meets the partitioning of the window.
    """
    df = df.withColumn("__g", F.struct(*keys, bucket.alias("__b")))
    sizes = df.groupBy("__g").agg(F.count("*").alias("__c")).select("__g", "__g.*", "__c")
    sizes = sizes.select("__g", _running_before(keys, "__b", "__c").alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__g").orderBy(*order))
    ranked = df.withColumn("__rn", inner).join(sizes, "__g")
    return ranked.withColumn(out, F.col("__before") + F.col("__rn")).drop("__g", "__before", "__rn")


def previous_in_group(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """``value`` of the row before, in the group's order; ``bucket`` must not decrease along it.

    Inside a bucket this is a plain lag. The first row of a bucket takes the last value of the
    bucket before it, from a table with one row per group and bucket. Rows with a null key or bucket stay.
    """
    df = df.withColumn("__g", F.struct(*keys, bucket.alias("__b")))
    last = df.groupBy("__g").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))
    last = last.select("__g", "__g.*", "__last").select("__g", before.alias("__carry"))
    inner = F.lag(value).over(Window.partitionBy("__g").orderBy(*order))
    joined = df.withColumn("__lag", inner).join(last, "__g")
    return joined.withColumn(out, F.coalesce("__lag", "__carry")).drop("__g", "__lag", "__carry")


def quota_column(group: str, quota: int | dict[str, int]) -> Column:
    """The caller's quota of a row's group: a literal lookup; groups without a quota get 0."""
    if isinstance(quota, int):
        return F.lit(quota)
    pairs = [x for k, v in quota.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.col(group)], F.lit(0))


def top_n_per_group(
    df: DataFrame, group: str, order: list[Column], quota: int | dict[str, int], id_col: str = "id",
    salts: int = 32,
) -> DataFrame:
    """First ``quota`` rows of each group in the given order, in two steps.

    Ranking per (group, salt) first leaves at most ``salts * quota`` rows for the final ranking of a
    group, however large it is; both steps are cut map-side by the window group limit. ``salts=1``
    skips the first step where groups are known to be small.
    """
    most = quota if isinstance(quota, int) else max(quota.values())
    if not isinstance(quota, int):
        df = df.filter(F.col(group).isin(list(quota)))
    if salts > 1:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
        part = Window.partitionBy(group, "__salt").orderBy(*order)
        df = salted.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= most)
        df = df.drop("__rn", "__salt")
    final = Window.partitionBy(group).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(final)).filter(F.col("__rn") <= most)
    return out.filter(F.col("__rn") <= quota_column(group, quota)).drop("__rn")


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], cut: bool = False,
    margin: float = 0.0005,
) -> DataFrame:
    """Exact quantiles with linear interpolation; columns: groups, ``n``, ``q`` (array<double>).

    The built-in exact percentile holds a group's distinct values in one task. Here a mergeable
    sketch proposes split points around each quantile, rows are counted between split points, and
    only the slice that holds a wanted rank is looked at value by value. Split points decide how even
    the slices are; ranks are counted exactly, so the result never depends on the sketch's error.
    ``cut`` writes the narrow (groups, value) table once when the input is costly to recompute.
    """
    keys = groups or ["__g"]
    v = F.col(value).cast("double")
    vals = df.select(*(groups or [F.lit(0).alias("__g")]), v.alias("__v"))
    vals = vals.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if cut:
        vals = materialize(vals, "values")
    points = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    sketch = vals.groupBy(*keys).agg(
        F.percentile_approx("__v", points, 10_000).alias("__s"), F.count("*").alias("n")
    )
    sketch = small_side(sketch, "sketch")
    slice_no = reduce(
        lambda a, b: a + b, [(F.col("__v") > F.col("__s")[i]).cast("int") for i in range(len(points))]
    )
    sliced = vals.join(sketch, keys).select(*keys, "__v", "n", slice_no.alias("__b"))
    cells = sliced.groupBy(*keys, "__b").agg(F.count("*").alias("__c"), F.max("n").alias("n"))
    cells = cells.withColumn("__before", _running_before(keys, "__b", "__c"))
    ranks = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("n") - 1)
        for side, rank in enumerate((F.floor(at), F.ceil(at))):
            ranks.append(F.struct(F.lit(2 * i + side).alias("slot"), rank.alias("rank")))
    hits = cells.withColumn("__t", F.explode(F.array(*ranks))).filter(
        (F.col("__before") <= F.col("__t.rank"))
        & (F.col("__t.rank") < F.col("__before") + F.col("__c"))
    )
    hits = hits.select(
        *keys, "__b", "n", F.col("__t.slot").alias("__slot"),
        (F.col("__t.rank") - F.col("__before")).alias("__within"),
    )
    wanted = hits.groupBy(*keys, "__b").agg(
        F.collect_list(F.struct("__slot", "__within")).alias("__w"), F.max("n").alias("n")
    )
    wanted = small_side(wanted, "ranks")
    counted = sliced.drop("n").join(wanted, [*keys, "__b"], "left_semi").groupBy(
        *keys, "__b", "__v"
    ).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(
        Window.partitionBy(*keys, "__b").orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cum = counted.withColumn("__upto", upto).join(wanted, [*keys, "__b"])
    cum = cum.withColumn("__t", F.explode("__w")).filter(
        (F.col("__t.__within") < F.col("__upto"))
        & (F.col("__t.__within") >= F.col("__upto") - F.col("__c"))
    )
    slots = {
        s: F.max(F.when(F.col("__t.__slot") == s, F.col("__v"))) for s in range(2 * len(probs))
    }
    found = cum.groupBy(*keys).agg(
        F.max("n").alias("n"), *[c.alias(f"__q{s}") for s, c in slots.items()]
    )
    qs = []
    for i, p in enumerate(probs):
        lo, hi = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        at = F.lit(p) * (F.col("n") - 1)
        qs.append(lo + (hi - lo) * (at - F.floor(at)))
    return found.select(*groups, "n", F.array(*qs).alias("q"))
