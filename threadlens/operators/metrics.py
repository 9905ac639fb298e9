"""Evaluation of predictions. Every table comes from counts, never from collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import materialize


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", loss: str | None = None
) -> DataFrame:
    """Accuracy and F1 of the positive class, with the mean loss when there is a loss column."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    out = [
        F.count("*").alias("n"),
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        _f1(F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)).alias("f1"),
    ]
    if loss:
        out.append(F.avg(loss).alias("loss"))
    return df.agg(*out)


def confusion_matrix(df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by label and prediction, one row per label of ``classes``, zeros filled in."""
    counts = df.groupBy(label).pivot(prediction, classes).count()
    every = df.sparkSession.createDataFrame([(c,) for c in classes], [label]).withColumn(
        label, F.col(label).cast(df.schema[label].dataType)
    )
    named = [F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes]
    return every.join(counts, label, "left").select(label, *named)


def classification_report(
    df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    y, p = F.col(label), F.col(prediction)
    cells = df.agg(
        F.count("*").alias("n"), F.count_if(y == p).alias("hits"),
        *[c for k in classes for c in (
            F.count_if((y == k) & (p == k)).alias(f"tp_{k}"),
            F.count_if(p == k).alias(f"pp_{k}"), F.count_if(y == k).alias(f"sup_{k}"),
        )],
    )

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"), f1.cast("double").alias("f1"),
            support.cast("long").alias("support"),
        )

    score, n = {}, F.col("n")
    for k in classes:
        tp, pp, sup = F.col(f"tp_{k}"), F.col(f"pp_{k}"), F.col(f"sup_{k}")
        score[k] = (safe(tp, pp), safe(tp, sup), safe(2 * tp, pp + sup), sup)
    rows = [row(str(k), *v) for k, v in score.items()]
    acc = F.col("hits") / n
    rows.append(row("accuracy", acc, acc, acc, n))
    macro = [sum((v[i] for v in score.values()), F.lit(0.0)) / len(classes) for i in range(3)]
    heavy = [sum((v[i] * v[3] for v in score.values()), F.lit(0.0)) / n for i in range(3)]
    rows += [row("macro avg", *macro, n), row("weighted avg", *heavy, n)]
    return cells.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _running_counts(counts: DataFrame) -> DataFrame:
    """Cumulative counts from the highest score down.

    Scores are range-partitioned into slices of like size, however they are distributed, and written
    once, which fixes the slice numbers. Slice totals give each slice its starting point, so the
    ordered sums run per slice and not over one global window.
    """
    sliced = counts.repartitionByRange(F.desc("threshold")).withColumn("__b", F.spark_partition_id())
    cut = materialize(sliced, "score-slices")
    totals = cut.groupBy("__b").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "__b", F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__p0"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        F.sum("__p").over(everything).alias("all_pos"), F.sum("__n").over(everything).alias("all_neg"),
    )
    inside = Window.partitionBy("__b").orderBy(F.desc("threshold")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = cut.withColumns({"__pi": F.sum("pos").over(inside), "__ni": F.sum("neg").over(inside)})
    return ranked.join(totals, "__b").select(
        "threshold", "pos", "neg", "all_pos", "all_neg",
        (F.col("__p0") + F.col("__pi")).alias("tp"), (F.col("__n0") + F.col("__ni")).alias("fp"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at every distinct score; the origin has an infinite threshold.

    Without positives or without negatives the matching rate is null.
    """
    run = _running_counts(score_counts(df, label, score))
    points = run.select(
        "threshold", (F.col("fp") / F.nullif("all_neg", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("all_pos", F.lit(0))).alias("tpr"),
    )
    origin = run.agg(F.max("all_neg").alias("n"), F.max("all_pos").alias("p")).select(
        F.lit(float("inf")).alias("threshold"), (0 / F.nullif("n", F.lit(0))).alias("fpr"),
        (0 / F.nullif("p", F.lit(0))).alias("tpr"),
    )
    return origin.unionByName(points)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores, so ties count half."""
    run = _running_counts(score_counts(df, label, score))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return run.agg(area.alias("a"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n")).select(
        (F.col("a") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc")
    )


def select_best_epoch(
    df: DataFrame, epoch: str = "epoch", score: str = "score", patience: int = 3, mode: str = "max"
) -> DataFrame:
    """Which epochs run before early stopping, which one is best, per training run table.

    An epoch that equals the best so far counts as an improvement; training stops after ``patience``
    epochs in a row that do not. The table has one row per epoch of one training run.
    """
    s = F.col(score) if mode == "max" else -F.col(score)
    order = Window.orderBy(epoch)
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max(s).over(seen)
    marked = df.withColumn("improved", F.coalesce(s >= best_before, F.lit(True)))
    marked = marked.withColumn("__run", F.sum(F.col("improved").cast("int")).over(order))
    since = Window.partitionBy("__run").orderBy(epoch)
    marked = marked.withColumn("waited", (F.row_number().over(since) - 1).cast("int"))
    stopped_before = F.coalesce(F.max((F.col("waited") >= patience).cast("int")).over(seen), F.lit(0))
    ran = marked.withColumn("ran", stopped_before == 0)
    last_improved = F.max(F.when(F.col("ran") & F.col("improved"), F.col(epoch))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ran.withColumn("is_best", F.col(epoch) == last_improved).drop("__run")
