"""Deterministic samples and splits by the hash of the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.operators.statistics import top_per_group


def hash_order(key: str):
    return F.md5(F.col(key).cast("string"))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly n rows in the order of their hashed key; each task keeps its own first n."""
    return df.orderBy(hash_order(key), key).limit(n)


def balanced_sample(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """Up to n rows per class; a class of any size is ranked in salted parts first."""
    return top_per_group(df, [label], [hash_order(key), key], n, spread_key=key)


def cut_offs(df: DataFrame, label: str, order, share: float) -> DataFrame:
    """(label, cut): the hash of the last of the first ``share`` rows of every class, null where there is none.

    Only labels and hashes are read.  Counts by the leading four hex digits find the slice of the cut, and only
    the rows of that slice are ranked.
    """
    slim = df.select(F.col(label).alias("_label"), order.alias("_order")).withColumn("_slice", F.substring("_order", 1, 4))
    counts = slim.groupBy("_label", "_slice").agg(F.count("*").alias("_c"))
    upto = W.partitionBy("_label").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sliced = counts.select(
        "_label", "_slice", "_c", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"),
        F.round(F.sum("_c").over(W.partitionBy("_label")) * share).alias("_want"),
    )
    at = sliced.filter((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_c")))
    at = at.select(F.col("_label").alias("_class"), F.col("_slice").alias("_at"), "_before", "_want")
    same = F.col("_label").eqNullSafe(F.col("_class")) & (F.col("_slice") == F.col("_at"))
    inside = slim.join(F.broadcast(at), same)  # a row per class
    ranked = inside.withColumn("_n", F.row_number().over(W.partitionBy("_label").orderBy("_order")))
    return ranked.filter(F.col("_n") == F.col("_want") - F.col("_before")).select("_label", F.col("_order").alias("_cut"))


def stratified_split(df: DataFrame, label: str, key: str, test_share: float) -> DataFrame:
    """Adds ``part``: the first ``test_share`` of every class by hashed key is 'test', the rest 'train'.

    Each row is compared with the cut of its class, so no other column is shuffled.
    """
    order = hash_order(key)
    cuts = F.broadcast(cut_offs(df, label, order, test_share))  # a row per class
    joined = df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    part = F.when(order <= F.col("_cut"), "test").otherwise("train")
    return joined.withColumn("part", part).drop("_label", "_cut")


def row_range(df: DataFrame, key: str, start: int, end: int, slices: int = 256) -> DataFrame:
    """Rows start..end-1 in key order, for an integer key; rows without a key come last, in any order.

    Approximate quantiles cut the keys into slices of about as many rows; exact counts per slice locate the
    rows, so only the slices that overlap the wanted rows are ranked.
    """
    shares = [k / slices for k in range(1, slices)]
    bounds, keyed, total = df.agg(F.percentile_approx(key, shares, 100 * slices), F.count(key), F.count("*")).first()
    low, high = max(0, start - keyed), min(max(0, end - keyed), total - keyed)
    unkeyed = df.filter(F.col(key).isNull()).limit(max(0, high - low))  # any rows do: they are ties
    if not keyed:
        return unkeyed
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    with_key = df.filter(F.col(key).isNotNull())
    sliced = with_key.withColumn("_slice", F.size(F.filter(cuts, lambda b: b < F.col(key))))
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_c"))
    before = W.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    wanted = offsets.filter((F.col("_before") < end) & (F.col("_before") + F.col("_c") > start)).drop("_c")
    within = F.row_number().over(W.partitionBy("_slice").orderBy(key))
    # at most one row per slice is broadcast
    ranked = sliced.join(F.broadcast(wanted), "_slice").withColumn("_n", F.col("_before") + within - 1)
    chosen = ranked.filter((F.col("_n") >= start) & (F.col("_n") < end)).drop("_slice", "_before", "_n")
    return chosen.unionByName(unkeyed) if high > low else chosen


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels in alphabetical order with ids from 0; the window runs over labels, not rows."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return names.withColumn("label_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(label)) - 1)
