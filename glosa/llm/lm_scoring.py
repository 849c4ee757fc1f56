"""Language-model scores by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides of it (``REACH`` each way), never from itself; the sum
of the conditional log-probabilities scores a document.  The network is small: embeddings of the window,
one tanh layer, and a token as a pair (class, member) with two softmax layers of ``SIDE`` outputs, the second
with a bias per class.  So a conditional distribution over SIDE * SIDE tokens costs two small products.

The vocabulary comes from word counts over all documents: the most frequent words get numbers of their own,
all others share ``BUCKETS`` numbers by hash.  The output biases start at the log of these counts.  A word of
a bucket scores log P(bucket | context) + log P(word | bucket), the latter from the counts of all words: the
``HOT`` most frequent words are broadcast, the others meet their counts in a join, where each of them has
less than a ``HOT``-th of all tokens (and a step of ``level``).  These logs are summed as whole numbers
(``UNIT``), so sums do not depend on an order.  Texts become token numbers once, in a written table.  Training
is local descent with averaging: in each round every task starts from the common weights, trains on its own
documents (of ``ROUNDS`` rounds each takes every ``ROUNDS``-th position of every document, another offset each
round, so that together they take every position once) and sends its weights, which are averaged by positions in two steps of grouping, so no group grows with the
number of tasks.  Only the averaged weights, of fixed size, come to the driver.

Defined results: a null, empty or blank text has no tokens, log_prob 0 and a null mean; equal texts get
equal scores; repeated rows are scored each; an empty table gives an empty result; further columns are not
read.  Weights depend on how rows fall into tasks, so scores of two runs may differ in late digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.llm import common
from glosa.session import written

SIDE, BUCKETS = 64, 512
WORDS = SIDE * SIDE - BUCKETS  # words with a number of their own
REACH, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE = 2, 2048, 0.08
#: Tokens whose outputs are held at once (they fit a core's cache), distinct words held before they are sent on, weights in one row, tasks per average.
BLOCK, HELD_WORDS, SLOT, FAN_IN = 1024, 200_000, 8192, 64
TEXTS = 256  # texts that are turned into numbers at once
HOT, UNIT = 262_144, 1_000_000_000  # words whose counts are broadcast, parts of a log that are counted
PAD = SIDE * SIDE

SHAPES = {
    "embed": (SIDE * SIDE + 1, WIDTH), "mix": (2 * REACH * WIDTH, HIDDEN), "mix_bias": (HIDDEN,),
    "first": (HIDDEN, SIDE), "first_bias": (SIDE,), "second": (HIDDEN, SIDE), "second_bias": (SIDE, SIDE),
}


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task sends its own counts."""

    def run(batches):
        import pyarrow as pa

        def rows(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(common.space_words(text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """word -> token number; words outside the vocabulary share hash buckets."""

    def __missing__(self, word: bytes) -> int:
        return WORDS + zlib.crc32(word) % BUCKETS


def bucket() -> Column:
    return F.crc32("word") % BUCKETS


def level() -> Column:
    """Whole eighths of the binary log of a count, so that a histogram of counts has a few hundred rows."""
    return F.floor(8 * F.log2("n")).cast("int")


@dataclass
class Lexicon:
    counts: DataFrame  # (word, n) of all words
    tail: DataFrame  # those that share numbers
    words: list[bytes]  # words with numbers of their own
    number: np.ndarray  # the count of every token number, one more than seen
    shared: np.ndarray  # the count of every bucket


def lexicon(docs: DataFrame) -> Lexicon:
    """The most frequent words, and the counts of all."""
    counts = written(word_counts(docs), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    words, number, shared = [bytes(r["word"]) for r in top], np.ones(SIDE * SIDE), np.zeros(BUCKETS)
    number[: len(words)] += [r["n"] for r in top]
    last = (F.lit(top[-1]["n"]), F.lit(bytes(top[-1]["word"]))) if len(top) == WORDS else (F.lit(0), F.lit(b""))
    tail = counts.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    for r in tail.groupBy(bucket().alias("k")).agg(F.sum("n").alias("n")).collect():
        shared[r["k"]] = r["n"]
    number[WORDS:] += shared
    return Lexicon(counts, tail, words, number, shared)


def vocabulary(docs: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, and the count of every token number."""
    found = lexicon(docs)
    return found.words, found.number


def hot_words(tail: DataFrame, most: int) -> tuple[list, int]:
    """(word, n) of all words of the levels that together have at most ``most`` words, and the lowest such level."""
    sizes = {r["level"]: r["count"] for r in tail.groupBy(level().alias("level")).count().collect()}
    total, lowest = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        lowest = k
    return tail.filter(level() >= lowest).collect(), lowest


def coded(docs: DataFrame, found: Lexicon, most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Written (row, doc_id, body, known, rare), and (word, part) of the rare words.

    ``body`` has the token numbers of a text, ``known`` the sum of log P(word | bucket) of its hot words, and
    ``rare`` its other words of buckets; ``part`` is log P(word | bucket), in parts of ``UNIT``.
    """
    hot, lowest = hot_words(found.tail, most)
    names = [bytes(r["word"]) for r in hot]
    at = np.array([zlib.crc32(w) % BUCKETS for w in names], np.int64)
    own = np.zeros(len(found.words))
    logs = np.concatenate([own, np.log([r["n"] for r in hot]) - np.log(found.shared[at])])
    numbers = np.concatenate([np.arange(len(own)), WORDS + at, [PAD]]).astype(np.int16)
    logs = np.append(np.rint(logs * UNIT), 0).astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((found.words + names, numbers, logs))

    def run(batches):
        import pyarrow as pa

        known_words, numbers, logs = sent.value
        place = {w: i for i, w in enumerate(known_words)}
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                bodies, known, rare = [], [], []
                for text in part.column(2).to_pylist():
                    words = common.space_words(text)
                    places = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    body = numbers[places]
                    missing = np.flatnonzero(places < 0).tolist()
                    rare.append([words[i] for i in missing])
                    body[missing] = [WORDS + zlib.crc32(w) % BUCKETS for w in rare[-1]]
                    bodies.append(body.tobytes())
                    known.append(int(logs[places].sum()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(bodies, pa.binary()), pa.array(known, pa.int64()),
                    pa.array(rare, pa.list_(pa.binary())),
                ], ["row", "doc_id", "body", "known", "rare"])

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("body", T.BinaryType()), T.StructField("known", T.LongType()),
        T.StructField("rare", T.ArrayType(T.BinaryType())),
    ])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    whole = F.element_at(F.array(*[F.lit(float(x)) for x in found.shared]), (bucket() + 1).cast("int"))
    parts = found.tail.filter(level() < lowest).select(
        "word", F.round((F.log("n") - F.log(whole)) * UNIT).cast("long").alias("part")
    )
    return written(rows.mapInArrow(run, schema), "token-numbers"), parts


def start_weights(number: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}
    out["embed"][:] = rng.normal(0, 0.3, SHAPES["embed"])
    out["mix"][:] = rng.normal(0, 1 / np.sqrt(2 * REACH * WIDTH), SHAPES["mix"])
    table = number.reshape(SIDE, SIDE)
    out["first_bias"][:] = np.log(table.sum(axis=1) / table.sum())
    out["second_bias"][:] = np.log(table / table.sum(axis=1, keepdims=True))
    return out


def to_line(weights: dict) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in SHAPES]).astype(np.float32)


def from_line(line: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = line[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def windows(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the tokens around the places ``at`` (of a padded row), without the places themselves."""
    around = [k for k in range(-REACH, REACH + 1) if k]
    return np.stack([tokens[at + k] for k in around], axis=1)


#: Outputs below this in size need no shift before their exponentials, which stay inside single precision.
SMALL_OUTPUT = 80.0


def small_outputs(w: dict) -> bool:
    """Whether no input can bring an output near the limits of single precision; hidden values lie in -1 to 1."""
    one = np.abs(w["first"]).sum(axis=0).max() + np.abs(w["first_bias"]).max()
    two = np.abs(w["second"]).sum(axis=0).max() + np.abs(w["second_bias"]).max()
    return bool(max(one, two) < SMALL_OUTPUT)


def by_number(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, an order that brings equal ones together, and where each begins in it."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    ordered = at[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begins], order, begins


def outputs(w: dict, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the outputs for all classes, and those for all members of the target's class."""
    one = h @ w["first"]
    one += w["first_bias"]
    two = h @ w["second"]
    two += w["second_bias"].take(target // SIDE, axis=0)
    if not small_outputs(w):
        one -= one.max(axis=1, keepdims=True)
        two -= two.max(axis=1, keepdims=True)
    return one, two


def mixed(w: dict) -> list[np.ndarray]:
    """What each token adds to the hidden inputs from each place of a window; the bias is in the first."""
    parts = [w["embed"] @ w["mix"][k * WIDTH : (k + 1) * WIDTH] for k in range(2 * REACH)]
    parts[0] += w["mix_bias"]
    return parts


def log_probs(w: dict, context: np.ndarray, target: np.ndarray, parts: list[np.ndarray] | None = None) -> np.ndarray:
    """Of each target in its context; ``parts`` is ``mixed(w)``, where it is known."""
    parts = parts or mixed(w)
    h = parts[0].take(context[:, 0], axis=0)
    for part, tokens in zip(parts[1:], context.T[1:], strict=True):
        h += part.take(tokens, axis=0)
    one, two = outputs(w, np.tanh(h, out=h), target)
    each, ones = np.arange(len(target)), np.ones(SIDE, one.dtype)
    chosen = one[each, target // SIDE] + two[each, target % SIDE]
    return chosen - np.log(np.exp(one, out=one) @ ones) - np.log(np.exp(two, out=two) @ ones)


def gradients(w: dict, context: np.ndarray, target: np.ndarray) -> dict[str, tuple]:
    """Of the mean negative log-probability: (rows of the weight that it is not zero for, its values there).

    Outputs exist for ``BLOCK`` targets at a time; the sum is over all.
    """
    n, every = len(target), slice(None)
    total = {name: np.zeros(w[name].shape, w[name].dtype) for name in SHAPES if name != "embed"}
    d_x = np.empty((n, 2 * REACH * WIDTH), w["embed"].dtype)
    for k in range(0, n, BLOCK):
        some, own = target[k : k + BLOCK], slice(k, k + BLOCK)
        x = w["embed"].take(context[own].ravel(), axis=0).reshape(len(some), -1)
        h = x @ w["mix"]
        h += w["mix_bias"]
        one, two = outputs(w, np.tanh(h, out=h), some)
        each, ones, all_ones = np.arange(len(some)), np.ones(SIDE, h.dtype), np.ones(len(some), h.dtype)
        for out, at in ((one, some // SIDE), (two, some % SIDE)):  # softmax, as a share of the mean
            np.exp(out, out=out)
            out *= (1 / (n * (out @ ones)))[:, None]
            out[each, at] -= 1 / n
        d_h = two @ w["second"].T
        d_h += one @ w["first"].T
        d_h *= 1 - h * h
        np.matmul(d_h, w["mix"].T, out=d_x[own])
        total["mix"] += x.T @ d_h
        total["mix_bias"] += all_ones @ d_h
        total["first"] += h.T @ one
        total["first_bias"] += all_ones @ one
        total["second"] += h.T @ two
        classes, order, begins = by_number(some // SIDE)
        total["second_bias"][classes] += np.add.reduceat(two.take(order, axis=0), begins, axis=0)
    tokens, order, begins = by_number(context.ravel())
    d_embed = np.add.reduceat(d_x.reshape(-1, WIDTH).take(order, axis=0), begins, axis=0)
    return {"embed": (tokens, d_embed), **{name: (every, g) for name, g in total.items()}}


def descend(w: dict, squares: dict, context: np.ndarray, target: np.ndarray) -> None:
    """One step; rows without a gradient stay as they are."""
    for name, (rows, g) in gradients(w, context, target).items():
        some = squares[name][rows] + g * g
        squares[name][rows] = some
        np.sqrt(some, out=some)
        np.divide(g, some, out=some)
        some *= RATE
        w[name][rows] -= some


def laid_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of many texts in one row with padding around each; their places; the text of each place."""
    lengths = np.array([len(r) for r in rows], np.int64)
    pad = np.full(REACH, PAD)
    tokens = np.concatenate([pad, *(x for r in rows for x in (r, pad))]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    return tokens, np.arange(len(owner)) + REACH * (owner + 1), owner


def padded(texts, number: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``laid_out`` of texts."""
    words = map(common.space_words, texts)
    return laid_out([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])


def decoded(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``laid_out`` of the bodies of a coded table."""
    return laid_out([np.frombuffer(b, np.int16) for b in bodies])


def totals(w: dict, tokens: np.ndarray, places: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and summed log-probabilities of ``n`` texts."""
    total, parts = np.zeros(n), mixed(w)
    for k in range(0, len(places), BLOCK):
        at = places[k : k + BLOCK]
        total += np.bincount(owner[k : k + BLOCK], log_probs(w, windows(tokens, at), tokens[at], parts), n)
    return np.bincount(owner, minlength=n), total


def slices(batches) -> Iterator[list]:
    """The first column of Arrow batches, a few rows at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, TEXTS):
            yield batch.column(0).slice(begin, TEXTS).to_pylist()


def targets(places: np.ndarray, owner: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places that a round trains on: every ``rounds``-th one of each text, from the ``turn``-th on."""
    lengths = np.bincount(owner)
    inside = np.arange(len(places)) - (np.cumsum(lengths) - lengths)[owner]
    return places[inside % rounds == turn]


def train_round(rows: DataFrame, line: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """One round of local descent on all rows of a coded table and the average of the tasks' weights."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        w = from_line(line.copy())
        squares = {n: np.full(s, 1e-4, np.float32) for n, s in SHAPES.items()}
        seen = 0
        for part in slices(batches):
            tokens, places, owner = decoded(part)
            chosen = targets(places, owner, turn, rounds)
            for k in range(0, len(chosen), BATCH):
                at = chosen[k : k + BATCH]
                descend(w, squares, windows(tokens, at), tokens[at])
                seen += len(at)
        if seen:
            out = to_line(w)
            slots = [out[k : k + SLOT] for k in range(0, len(out), SLOT)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(slots)), pa.int32()), pa.array([task] * len(slots), pa.int32()),
                pa.array([float(seen)] * len(slots)), pa.array([s.tobytes() for s in slots], pa.binary()),
            ], ["slot", "task", "weight", "body"])

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        weight = group["weight"].to_numpy()
        total = sum(np.frombuffer(b, np.float32) * float(x) for b, x in zip(group["body"], weight, strict=True))
        body = (total / weight.sum()).astype(np.float32).tobytes()
        return pd.DataFrame([(int(group["slot"].iloc[0]), int(group["task"].iloc[0]), float(weight.sum()), body)],
                            columns=["slot", "task", "weight", "body"])

    schema = "slot int, task int, weight double, body binary"
    sent = rows.select("body").mapInArrow(run, schema)
    part = sent.groupBy("slot", F.floor(F.col("task") / FAN_IN).alias("team")).applyInPandas(average, schema)
    slots = part.groupBy("slot").applyInPandas(average, schema).collect()
    if not slots:
        return line
    return np.concatenate([np.frombuffer(r["body"], np.float32) for r in sorted(slots, key=lambda r: r["slot"])])


def train(rows: DataFrame, number: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a network trained on a coded table."""
    line = to_line(start_weights(number))
    for turn in range(rounds):
        line = train_round(rows, line, turn, rounds)
    return line


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """Vocabulary and weights of a network trained on ``docs``."""
    found = lexicon(docs)
    return found.words, train(coded(docs, found)[0], found.number, rounds)


def scores(text: Column, words: list[bytes], line: np.ndarray) -> Column:
    """Struct of n_tokens and log_prob of a text column, where words of a bucket score as their bucket."""

    @F.pandas_udf("n_tokens long, log_prob double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, number = from_line(line), Numbers({x: i for i, x in enumerate(words)})
        for batch in series:
            parts = [batch.iloc[k : k + TEXTS] for k in range(0, len(batch), TEXTS)]
            done = [totals(w, *padded(part, number), len(part)) for part in parts]
            count, total = (np.concatenate(x) for x in zip(*done, strict=True)) if done else ([], [])
            yield pd.DataFrame({"n_tokens": count, "log_prob": total})

    return run(F.coalesce(text.cast("string"), F.lit("")))


def body_scores(body: Column, line: np.ndarray) -> Column:
    """``scores`` of the bodies of a coded table."""

    @F.pandas_udf("n_tokens long, log_prob double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = from_line(line)
        for batch in series:
            parts = [batch.iloc[k : k + TEXTS] for k in range(0, len(batch), TEXTS)]
            done = [totals(w, *decoded(list(part)), len(part)) for part in parts]
            count, total = (np.concatenate(x) for x in zip(*done, strict=True)) if done else ([], [])
            yield pd.DataFrame({"n_tokens": count, "log_prob": total})

    return run(body)


def score_documents(docs: DataFrame, most: int = HOT) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every document under a network trained on all."""
    found = lexicon(docs)
    rows, parts = coded(docs, found, most)
    line = train(rows, found.number)
    rare = rows.select("row", F.explode("rare").alias("word")).join(parts, "word")
    rare = rare.groupBy("row").agg(F.sum("part").alias("part"))
    scored = rows.select("row", "doc_id", "known", body_scores(F.col("body"), line).alias("scored_"))
    scored = scored.select("row", "doc_id", "known", "scored_.*").join(rare, "row", "left")
    inside = (F.col("known") + F.coalesce("part", F.lit(0))) / UNIT
    scored = scored.select("doc_id", "n_tokens", (F.col("log_prob") + inside).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.withColumn("mean_log_prob", mean)


@common.query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return score_documents(common.table(spark, sf_dir, "documents"))
