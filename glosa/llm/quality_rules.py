"""Quality rules: base rules, then an isolation forest on the statistics the rules look at.

A forest of random cuts is grown on all good labelled documents that pass the base rules: every one of them is dealt
to a tree, or to several while there are few.  The trees grow level by level, from the boxes of their nodes, which
Spark aggregates over the rows.  The statistics are rank-transformed, so that wide tails do not pass for anomalies, and
go on linearly beyond what these rows have; the ranks are exact, and ``RANKS`` of them are held.  A cut takes a statistic in proportion to its range among the node's rows, at a random place.  A scored
row belongs to the node, too: where it lies outside, a random cut falls between it and the others with a known
probability and isolates it at that depth, so its path length is an expectation over all such cuts.  Documents that
few cuts isolate have short paths and a score near 1.  The threshold comes from all labelled rows, good and bad: the
lowest one that rejects at most ``MAX_FALSE`` of the good ones, half way to the next bad one.

Defined results: a null or empty text has zero counts and fails the base rules (under ten words); without
labelled rows, or without bad ones among them, the forest rejects nothing; equal texts get equal verdicts;
repeated rows are judged each; a score equal to the threshold is kept; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.llm import common, text_stats
from glosa.session import written

#: Order statistics of all rows that rank a statistic, trees, and rows that each tree has at least, if there are so many.
RANKS, TREES, TREE_ROWS = 20_000, 64, 256
#: Largest share of good labelled rows that the threshold may reject.
MAX_FALSE = 0.0005
SEED = 20_240_501
#: Cuts above a leaf at most, and the range that statistics without any spread are given.
DEPTH, LEAST_RANGE = 12, 0.02
#: Statistics the forest splits on, besides ``variety``; none grows with the length of a text.
USED = [
    text_stats.FEATURES.index(n)
    for n in ("word_length", "symbol_share", "dup_line_share", "repeat_share", "mark_share", "symbol_word_share", "bar_rate")
]


def rule_statistics(features: np.ndarray) -> np.ndarray:
    """The used statistics and the variety of words: log of the distinct words over log of all words."""
    n = np.maximum(np.expm1(features[:, text_stats.FEATURES.index("log_words")].astype(np.float64)), 2)
    distinct = np.maximum(n * features[:, text_stats.FEATURES.index("distinct_share")], 1)
    return np.column_stack([features[:, USED], np.log(distinct) / np.log(n)])


def placed(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mean rank, 0 to 1, among the sorted columns of ``known``; below and above them distances in their ranges."""
    out = np.empty(x.shape)
    for k, column in enumerate(known.T):
        low, high = column[0], column[-1]
        rank = np.searchsorted(column, x[:, k], "left") + np.searchsorted(column, x[:, k], "right")
        beyond = np.minimum(x[:, k] - low, 0) + np.maximum(x[:, k] - high, 0)
        out[:, k] = rank / (2 * len(column)) + beyond / max(high - low, LEAST_RANGE)
    return out


def expected_depth(n):
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.maximum(np.asarray(n, np.float64), 1)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


@dataclass
class Forest:
    low: np.ndarray  # (trees, nodes, statistics): the box of a node's rows
    high: np.ndarray
    feature: np.ndarray  # (trees, nodes); -1 at leaves
    split: np.ndarray
    left: np.ndarray  # the right child follows the left one
    length: np.ndarray  # path length of a row that ends in a leaf
    norm: float
    known: np.ndarray | None = None  # sorted columns that rank the statistics
    threshold: float = np.inf

    def path_lengths(self, tree: int, x: np.ndarray) -> np.ndarray:
        """Expected number of cuts that isolate each row in one tree."""
        low, high, feature = self.low[tree], self.high[tree], self.feature[tree]
        out, still = np.zeros(len(x)), np.ones(len(x))  # probability that no cut has isolated the row
        rows, node, depth = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        while len(rows):
            own = x[rows]
            outside = (np.maximum(low[node] - own, 0) + np.maximum(own - high[node], 0)).sum(axis=1)
            extent = (high[node] - low[node]).sum(axis=1)
            now = outside / np.maximum(outside + extent, 1e-300)
            out[rows] += still[rows] * now * depth
            still[rows] *= 1 - now
            inner = feature[node] >= 0
            ended = ~inner
            out[rows[ended]] += still[rows[ended]] * self.length[tree][node[ended]]
            rows, node, own = rows[inner], node[inner], own[inner]
            right = own[np.arange(len(rows)), feature[node]] >= self.split[tree][node]
            node, depth = self.left[tree][node] + right, depth + 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus mean path length over expected length; 0 to 1, high is anomalous."""
        total = sum((self.path_lengths(t, x) for t in range(len(self.feature))), np.zeros(len(x)))
        return np.exp2(-total / len(self.feature) / self.norm)


def boxes(x: np.ndarray, tree: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int):
    """(tree, node, rows, low, high) of the nodes that rows of the trees are in after ``depth`` cuts."""
    feature, split, left = cuts
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[tree, node]
        rows, tree, node, f = rows[f >= 0], tree[f >= 0], node[f >= 0], f[f >= 0]
        node = left[tree, node] + (x[rows, f] >= split[tree, node])
    order = np.lexsort((node, tree))
    rows, tree, node = rows[order], tree[order], node[order]
    start = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]) if len(rows) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(rows)])
    if not len(start):
        return tree, node, count, np.zeros((0, x.shape[1])), np.zeros((0, x.shape[1]))
    return tree[start], node[start], count, np.minimum.reduceat(x[rows], start), np.maximum.reduceat(x[rows], start)


def grown(level: Callable, trees: int, rows: float, width: int, seed: int) -> Forest:
    """A forest of random cuts; ``level(cuts, depth)`` gives the boxes of the nodes at a depth.

    A node is a leaf if its rows are equal, at depth ``DEPTH``, or if it has a ``TREE_ROWS``-th of the ``rows`` of a tree.
    """
    low, high = np.zeros((trees, 2, width)), np.zeros((trees, 2, width))
    feature, left = np.full((trees, 2), -1, np.int64), np.zeros((trees, 2), np.int64)
    split, length, used = np.zeros((trees, 2)), np.zeros((trees, 2)), np.ones(trees, np.int64)
    for depth in range(DEPTH + 1):
        found = sorted(zip(*level((feature, split, left), depth)), key=lambda b: (b[0], b[1]))
        for t, node, count, lowest, highest in found:
            low[t, node], high[t, node] = lowest, highest
            length[t, node] = depth + expected_depth(count)
            extent = high[t, node] - low[t, node]
            if depth >= DEPTH or count <= max(1, rows / TREE_ROWS) or not extent.any():
                continue
            rng = np.random.default_rng([seed, int(t), int(node)])
            f = rng.choice(width, p=extent / extent.sum())
            place = rng.uniform(low[t, node, f], high[t, node, f])
            if place <= low[t, node, f]:
                continue
            if used[t] + 2 > feature.shape[1]:
                more = feature.shape[1]
                low, high = (np.pad(a, ((0, 0), (0, more), (0, 0))) for a in (low, high))
                left, split, length = (np.pad(a, ((0, 0), (0, more))) for a in (left, split, length))
                feature = np.pad(feature, ((0, 0), (0, more)), constant_values=-1)
            feature[t, node], split[t, node], left[t, node] = f, place, used[t]
            used[t] += 2
        if not (feature[[b[0] for b in found], [b[1] for b in found]] >= 0).any():
            break
    return Forest(low, high, feature, split, left, length, float(max(expected_depth(rows), 1e-9)))


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """A forest on rows in memory, each tree on its own random ones."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    own = np.concatenate([x[rng.choice(len(x), rows, replace=False)] for _ in range(trees)])
    tree = np.repeat(np.arange(trees), rows)
    return grown(lambda cuts, depth: boxes(own, tree, cuts, depth), trees, rows, x.shape[1], seed)


def grow_on(rows: DataFrame, n: int, width: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest on all ``n`` rows (hash, x): each goes to as many trees as give every tree ``TREE_ROWS`` rows, or to one.

    The driver sees the boxes of one level at a time; a tree has some hundred nodes however many rows there are.
    """
    copies = min(trees, -(-TREE_ROWS * trees // n))
    names = [f"{side}{k}" for side in ("low", "high") for k in range(width)]

    def level(cuts, depth: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                x = np.vstack(frame["x"].to_numpy())
                tree = (frame["hash"].to_numpy()[:, None] + np.arange(copies)).ravel() % trees
                t, node, count, low, high = boxes(np.repeat(x, copies, axis=0), tree, cuts, depth)
                yield pd.DataFrame({"tree": t, "node": node, "n": count, **dict(zip(names, np.hstack([low, high]).T))})

        schema = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in names)
        some = rows.mapInPandas(run, schema).groupBy("tree", "node")
        got = some.agg(F.sum("n").alias("n"), *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in names]).toPandas()
        box = got[names].to_numpy(np.float64)
        return got["tree"].to_numpy(), got["node"].to_numpy(), got["n"].to_numpy(), box[:, :width], box[:, width:]

    return grown(level, trees, n * copies / trees, width, seed)


def order_statistics(rows: DataFrame, n: int, width: int, ranks: int = RANKS) -> np.ndarray:
    """Sorted columns of the arrays ``x`` of ``n`` rows: all their values, or ``ranks`` evenly spaced ones, ends included.

    Values are counted and sorted by range; running offsets of the ranges give every value its exact ranks.
    """
    size = min(n, ranks)
    counted = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("c"))
    parts = written(counted.repartitionByRange("k", "v").withColumn("_part", F.spark_partition_id()), "ranked")
    totals = parts.groupBy("k", "_part").agg(F.sum("c").alias("n_")).collect()  # one row for each range of a column
    before, offsets = dict.fromkeys(range(width), 0), []
    for r in sorted(totals, key=lambda r: (r["k"], r["_part"])):
        offsets.append((r["k"], r["_part"], before[r["k"]]))
        before[r["k"]] += r["n_"]
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "k int, _part int, before long"))
    upto = F.sum("c").over(W.partitionBy("k", "_part").orderBy("v")) + F.col("before")
    spans = parts.join(known, ["k", "_part"]).select("k", "v", "c", upto.alias("upto"))
    # place j holds the value with the rank j * last div steps
    steps, last = max(size - 1, 1), max(n - 1, 1)
    first, after = (F.expr(f"({rank} * {steps} + {last - 1}) div {last}") for rank in ("(upto - c)", "upto"))
    spans = spans.select("k", "v", first.alias("a"), (after - 1).alias("b")).filter("a <= b").collect()  # ``ranks`` a column
    out = np.empty((size, width))
    for r in spans:
        out[r["a"] : r["b"] + 1, r["k"]] = r["v"]
    return out


def halfway(limit: float, above: float | None, lowest: float | None) -> float:
    """Between the highest score to keep and the next bad one; ``lowest`` is that of all bad ones."""
    if lowest is None or above is None:
        return np.inf
    return float((limit + above) / 2) if np.isfinite(limit) else float(lowest / 2)


def calibrate(good: np.ndarray, bad: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """Scores above the result are rejected."""
    allowed = int(max_false * len(good))
    limit = np.sort(good)[len(good) - 1 - allowed] if len(good) else -np.inf
    above = bad[bad > limit]
    return halfway(limit, above.min() if len(above) else None, bad.min() if len(bad) else None)


def calibrated(scores: DataFrame, max_false: float = MAX_FALSE) -> float:
    """``calibrate`` on a table (label, score) of any size."""
    good = scores.filter("label = 1").select("score")
    allowed = int(max_false * good.count())
    at = good.orderBy(F.desc("score")).offset(allowed).limit(1).first()
    limit = at["score"] if at else -np.inf
    bad = scores.filter("label = 0").agg(F.min(F.when(F.col("score") > F.lit(limit), F.col("score"))).alias("a"), F.min("score").alias("l")).first()
    return halfway(limit, bad["a"], bad["l"])


def fails_base(base: np.ndarray) -> np.ndarray:
    n, repeated = base[:, 0], base[:, text_stats.BASE.index("n_repeat_words")]
    return (n < 10) | (100 * repeated > 20 * n)


def anomaly(forest: Forest, features: np.ndarray) -> np.ndarray:
    return forest.score(placed(rule_statistics(features), forest.known))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, base counts, features) of every row, written: each text is read once."""
    stats = docs.select("doc_id", F.xxhash64("text").alias("hash"), text_stats.statistics(F.col("text")).alias("stats_"))
    return written(stats.select("doc_id", "hash", "stats_.*"), "rule-statistics")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, hash, features) of every labelled document that passes the base rules, written.

    Of repeated labels of an id the smallest counts, of repeated documents of an id the one with the smallest text hash.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    own = F.struct("features", *text_stats.BASE)
    one = rows.groupBy("doc_id").agg(F.min_by(own, "hash").alias("own")).join(known, "doc_id").select("doc_id", "label", "own.*")
    passed = one.filter(~((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    return written(passed.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("hash"), "features"), "labelled-statistics")


def _mapped(rows: DataFrame, work: Callable, kind: str, name: str) -> DataFrame:
    """Adds a column made by ``work`` from the matrix of the features of a batch."""

    @F.pandas_udf(kind)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            yield pd.Series(list(work(text_stats.matrix(batch))) if len(batch) else [])

    return rows.withColumn(name, run("features"))


def fit_measured(rows: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest with a threshold from all labelled rows; None without usable ones."""
    known = labelled(rows, labels)
    n = {bool(r["good"]): r["n"] for r in known.groupBy((F.col("label") == 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    usual, n_usual = (known.filter("label = 1"), n[True]) if True in n else (known, n[False])
    width = len(USED) + 1
    ranks = order_statistics(_mapped(usual, rule_statistics, "array<double>", "x"), n_usual, width)
    placed_rows = _mapped(usual, lambda f: placed(rule_statistics(f), ranks), "array<double>", "x")
    forest = grow_on(written(placed_rows.select("hash", "x"), "ranked-statistics"), n_usual, width)
    forest.known = ranks
    scored = _mapped(known, lambda f: anomaly(forest, f), "double", "score")
    forest.threshold = calibrated(written(scored.select("label", "score"), "label-scores"))
    return forest


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest with a threshold from all labelled documents; None without usable rows."""
    return fit_measured(measured(docs), labels)


def judged(base: np.ndarray, features: np.ndarray, forest: Forest | None) -> pd.DataFrame:
    """Base counts, base_failed, anomaly and kept of measured texts."""
    out = pd.DataFrame(base.reshape(-1, len(text_stats.BASE)), columns=text_stats.BASE)
    out["base_failed"] = fails_base(base)
    score = anomaly(forest, features) if forest and len(features) else np.zeros(len(base))
    out["anomaly"] = score
    out["kept"] = ~out["base_failed"] & (score <= (forest.threshold if forest else np.inf))
    return out


VERDICT = ", ".join([f"{n} long" for n in text_stats.BASE]) + ", base_failed boolean, anomaly double, kept boolean"


def verdicts(text: Column, forest: Forest | None) -> Column:
    """Struct of the base counts, base_failed, anomaly and kept of a text column."""

    @F.pandas_udf(VERDICT)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.kept()
        for batch in series:
            counts = [text_stats.measure(t) for t in batch]
            base = np.array([m[0] for m in counts], np.int64).reshape(-1, len(text_stats.BASE))
            yield judged(base, np.array([m[1] for m in counts], np.float32).reshape(len(base), -1), forest)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept and anomaly for every document."""
    rows = measured(docs)
    forest = fit_measured(rows, labels)

    @F.pandas_udf(VERDICT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for *base, features in batches:
            yield judged(np.column_stack(base).astype(np.int64), text_stats.matrix(features), forest)

    return rows.select("doc_id", run(*text_stats.BASE, "features").alias("judged_")).select("doc_id", "judged_.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    forest = fit(docs, labels)
    rows = common.packed(docs).withColumn("judged_", verdicts(common.field("text"), forest))
    return rows.filter("judged_.kept").select("row_.*")


@common.query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
