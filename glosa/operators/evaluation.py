"""Agreement of annotators and quality of predictions, from label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.session import side_by_side


def argmax_label(scores: dict[str, str]) -> Column:
    """Label of the highest score; ties go to the first label, null if every score is null."""
    best = F.greatest(*[F.col(c) for c in scores.values()])
    return F.coalesce(*[F.when(F.col(c) == best, F.lit(label)) for label, c in scores.items()])


def pair_counts(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Rows per (truth, predicted) where both are known: the only pass over the rows."""
    known = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Every pair of labels with its count and its share of the true label's row."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    filled = grid.join(pairs, ["truth", "predicted"], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy("truth"))
    return filled.select("truth", "predicted", "n", F.round(F.try_divide(F.col("n") * 1.0, total), 6).alias("share"))


def class_report(pairs: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where the denominator is 0."""
    same = F.col("truth") == F.col("predicted")
    counted = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                         F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                         F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")),
            )
        ),
    )
    sums = counted.filter(F.col("label").isin(labels)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "chosen")]
    )
    precision = F.coalesce(F.try_divide(F.col("tp") * 1.0, "chosen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp") * 1.0, "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("chosen") + F.col("support")), F.lit(0.0))
    return sums.select(
        *by, "label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(f1, 6).alias("f1"), "support",
    )


def accuracy_report(pairs: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """Accuracy, macro F1 over the given labels, support-weighted F1, rows."""
    same = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    accuracy = pairs.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.round(F.sum(same) / F.sum("n"), 6).alias("accuracy")
    )
    classes = class_report(pairs, labels, *by)
    f1 = classes.groupBy(*by).agg(
        F.round(F.sum("f1") / len(labels), 6).alias("macro_f1"),
        F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"),
    )
    if by:
        return accuracy.join(f1, list(by))
    return side_by_side(accuracy, f1)


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Agreement beyond chance of two label columns, from their pair counts."""
    same = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), same.alias("same")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("same")),
            )
        )
    )
    per_label = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("a", "b", "same")])
    sums = per_label.agg(
        F.sum("a").alias("pairs"),
        F.sum("same").alias("agreed"),
        F.sum(F.col("a").cast("double") * F.col("b")).alias("cross"),
    )
    po = F.try_divide(F.col("agreed") * 1.0, F.col("pairs"))
    pe = F.try_divide(F.col("cross"), F.col("pairs").cast("double") * F.col("pairs"))
    return sums.select(
        "pairs", F.round(po, 6).alias("agreement"), F.round(pe, 6).alias("chance"),
        F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"),
    )


def precision_recall(df: DataFrame, truth: str, scores: dict[str, str], classes: list[str], slices: int = 256) -> DataFrame:
    """Precision and recall of each class at every distinct score.

    Rows are first counted per class and score.  The running sums are two-level:
    within a slice of the scores, then over the slices.  Approximate quantiles of the distinct scores
    cut the slices, so no task orders all scores of a class, wherever they pile up.
    """
    long = df.filter(F.col(truth).isNotNull()).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("label"), F.col(scores[c]).alias("threshold"),
                             (F.col(truth) == c).cast("long").alias("hit"))
                    for c in classes
                ]
            )
        )
    ).filter("threshold IS NOT NULL")
    counts = long.groupBy("label", "threshold").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    shares = [k / slices for k in range(1, slices)]
    bounds = counts.groupBy("label").agg(F.percentile_approx("threshold", shares, 100 * slices).alias("_bounds"))
    counts = counts.join(F.broadcast(bounds), "label")  # one row per class
    counts = counts.withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < F.col("threshold")))).drop("_bounds")
    slices = counts.groupBy("label", "_slice").agg(F.sum("hits").alias("sh"), F.sum("n").alias("sn"))
    above = W.partitionBy("label").orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select(
        "label", "_slice", F.coalesce(F.sum("sh").over(above), F.lit(0)).alias("oh"),
        F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("on"),
        F.sum("sh").over(W.partitionBy("label")).alias("positives"),
    )
    inside = W.partitionBy("label", "_slice").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    running = counts.withColumns({"rh": F.sum("hits").over(inside), "rn": F.sum("n").over(inside)})
    joined = running.join(offsets, ["label", "_slice"])
    tp, chosen = F.col("rh") + F.col("oh"), F.col("rn") + F.col("on")
    return joined.select(
        "label", F.round("threshold", 6).alias("threshold"),
        F.round(tp / chosen, 6).alias("precision"),
        F.round(F.try_divide(tp * 1.0, "positives"), 6).alias("recall"),
    )


def compare_models(df: DataFrame, truth: str, models: list[str], labels: list[str]) -> DataFrame:
    """Accuracy and F1 of several prediction columns; predictions outside the labels are left out."""
    long = df.unpivot([truth], models, "model", "predicted").filter(F.col("predicted").isin(labels))
    return accuracy_report(pair_counts(long, truth, "predicted", "model"), labels, "model")
