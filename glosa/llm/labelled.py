"""Bounded sample of labelled documents for fitting small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import text_stats


def labelled_features(docs: DataFrame, labels: DataFrame, limit: int, where: Column | None = None):
    """(base counts, features, label) of at most ``limit`` labelled documents, as numpy arrays.

    The ids with the smallest hashes are taken, so the sample does not depend on the order of rows.  Of
    repeated labels of an id the smallest counts, of repeated documents of an id the one with the smallest
    text hash.  Only the ``limit`` ids are broadcast and only their numbers come to the driver.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label_")).dropna()
    if where is not None:
        rows = rows.filter(where)
    picked = (
        rows.groupBy("doc_id").agg(F.min("label_").alias("label_")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    measured = texts.select(
        "doc_id", "label_", F.xxhash64("text").alias("hash_"), text_stats.statistics(F.col("text")).alias("stats_")
    )
    one = measured.groupBy("doc_id").agg(F.min_by(F.struct("label_", "stats_"), "hash_").alias("row_"))
    got = one.select("doc_id", "row_.label_", "row_.stats_.*").toPandas().sort_values("doc_id")
    base = got[text_stats.BASE].to_numpy(np.int64)
    return base, text_stats.matrix(got["features"]), got["label_"].to_numpy(np.int64)
