"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitting takes a bounded sample of labelled documents (``SAMPLE`` ids with the smallest hashes, outside the
held-out fold).  Each statistic is cut into at most ``BINS`` bins at its quantiles; every level of a tree sums
gradients by (node, statistic, bin) and takes the best cut.  Trees are stored as arrays of complete binary
trees, so a batch of rows descends all of them with a few numpy steps.

Defined results: a null or empty text has all-zero statistics and gets the score the trees give to them;
without labelled rows, or with one class only, every score is the share of label 1 (0.5 without rows);
equal texts get equal scores, repeated rows are scored each; a null doc_id is never held out; label, language,
source and id are not read for a score, nor are further columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common, text_stats
from glosa.llm.labelled import labelled_features

#: Labelled documents that the trees are fitted on.
SAMPLE = 20_000
BINS, DEPTH, ROUNDS, RATE, SMOOTHING, LEAST_ROWS = 64, 4, 80, 0.15, 1.0, 10
PREDICT_AT = 0.7


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Trees:
    start: float
    feature: np.ndarray  # (trees, inner nodes), in heap order
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray, block: int = 8192) -> np.ndarray:
        out = np.empty(len(x))
        trees, inner = np.arange(len(self.feature))[None, :], self.feature.shape[1]
        for at in range(0, len(x), block):
            part = x[at : at + block]
            node, rows = np.zeros((len(part), len(self.feature)), np.int64), np.arange(len(part))[:, None]
            while len(self.feature) and node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            margin = self.start + (self.leaf[trees, node - inner].sum(axis=1) if len(self.feature) else 0.0)
            out[at : at + block] = 1 / (1 + np.exp(-margin))
        return out


def cuts_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin edges half way between neighbouring distinct quantiles."""
    points = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="nearest"))
    return (points[1:] + points[:-1]) / 2


def boost(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, rounds: int = ROUNDS) -> Trees:
    """Trees for the logistic loss."""
    share = y.mean() if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or not 0 < share < 1:
        start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, d = x.shape
    edges = [cuts_of(x[:, j].astype(np.float64)) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    out = Trees(float(np.log(share / (1 - share))), np.zeros((rounds, inner), np.int64),
                np.full((rounds, inner), np.inf), np.zeros((rounds, leaves)))
    margin = np.full(n, out.start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = node - first
            best = np.zeros(width)
            chosen = np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            for j in range(d):
                key = here * BINS + binned[:, j]
                sums = [np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                        for w in (gradient, hessian, np.ones(n))]
                (g, h, c), total = sums, [s[:, -1:] for s in sums]
                gain = g**2 / (h + SMOOTHING) + (total[0] - g) ** 2 / (total[1] - h + SMOOTHING)
                gain = gain - total[0] ** 2 / (total[1] + SMOOTHING)
                gain[(c < LEAST_ROWS) | (total[2] - c < LEAST_ROWS)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best = np.where(better, value, best)
                chosen[0][better], chosen[1][better] = j, at[better]
            for k in range(width):
                j, b = chosen[0][k], chosen[1][k]
                out.feature[t, first + k] = j
                out.cut[t, first + k] = edges[j][b] if b < len(edges[j]) else np.inf
            node = 2 * node + 1 + (binned[np.arange(n), chosen[0][here]] > chosen[1][here])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=leaves) for w in (gradient, hessian))
        out.leaf[t] = -RATE * g / (h + SMOOTHING)
        margin += out.leaf[t][leaf]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    _, features, label = labelled_features(docs, labels, sample, ~held_out(F.col("doc_id")))
    return boost(features, label.astype(np.float64))


def score(text: Column, trees: Trees) -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            rows = [text_stats.measure(t)[1] for t in batch]
            yield pd.Series(trees.score(np.array(rows, np.float32).reshape(len(rows), -1)))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = docs.select("doc_id", score(F.col("text"), fit(docs, labels, sample)).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )


@common.query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
