"""Filter interaction audit by incremental retraction streaming.

The files of the table are a stream of available-now micro-batches.  Four of the five filters look at one text
alone and give its mask; the fifth, an equal text under a smaller id, needs the whole table.  The keyed state has
for every text, by digest, the smallest id so far and the rows that hold it.  A key is a slice of the digests; there
are so many keys that each has some hundred texts at every size of the table, as Python pays for each key it is
called for.  A row of a larger id is counted as a copy at once.  When a smaller id arrives, the rows of the former one are retracted from the counters of their
part under their old mask and added under the mask of a copy.  Each batch adds its net changes to the counters,
(part, mask) with three numbers, in a folder named by the batch, so a repeated batch replaces what it wrote.  All
orders of the filters follow from the counters: five filters have 32 masks.

Copies within a task are merged before the shuffle, so a text that a third of all rows share sends few rows.
Only digests and numbers are shuffled.  The state lies in RocksDB and the stream's progress in the checkpoint,
both under ``spark.checkpoint.dir``, from which lost executors recover.

Defined results: a null text is an empty one; a null source is the part ''; a null doc_id is smaller than none
and none is smaller than it, so the row is never a copy; rows that share an id and a text are no copies of each
other; several labels of an id count if any of them does, labels without an id never do; a long text is split
into words whole, in one row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.session import work_dir

#: Contract: the filters, each a bit of the mask in this order.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: A micro-batch has this many scan splits for each core of the cluster, and this many bytes at the least.
WAVES, LEAST_BYTES = 4, 64 << 20
#: Bytes of the table for one key of the state.
KEY_BYTES = 256 << 10
#: Rows whose copies a task merges at once.
MERGED_ROWS = 50_000
#: The state may outgrow memory.  Without the second setting an almost empty store takes megabytes of disk.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

WORD_ENDS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column, words: Column, distinct: Column) -> Column:
    """Bits of the four filters that look at one text."""
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    rules = [words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, doc_id, part, mask, good, toxic of every document."""
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    text = common.text_or_empty()
    words = F.filter(F.split(F.col("text_"), WORD_ENDS), lambda w: w != "")

    def judged(words: Column) -> Column:
        mask = text_mask(F.col("text_"), F.size(words), F.size(F.array_distinct(words)))
        digest = F.sha2(F.encode("text_", "utf-8"), 256)
        return F.struct(mask.cast("int").alias("mask"), digest.alias("digest"))

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text_"),
    )
    rows = slim.select("doc_id", "part", F.inline(F.transform(F.array(words), judged)))  # the words stay a variable
    known = rows.join(flags, rows.doc_id == flags.labelled_id, "left")
    return known.select(*rows.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


GROUP = ["digest", "part", "mask", "good", "toxic"]


def merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row) for equal texts of a part and its labels.

    The row is text: digest, mask, good, toxic, smallest id (or nothing), rows that have it, rows in all, part.  The
    keyed state converts column by column for every key, so one column is handed over instead of eight.
    """
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        by_id = table.group_by(["key", *GROUP, "doc_id"], use_threads=False).aggregate([([], "count_all")])
        by_id = by_id.append_column("no_id", by_id["doc_id"].is_null()).sort_by([("doc_id", "ascending")])
        out = by_id.group_by(["key", *GROUP, "no_id"], use_threads=False).aggregate(
            [("doc_id", "min"), ("count_all", "first"), ("count_all", "sum")]
        )
        names = ("digest", "mask", "good", "toxic", "doc_id_min", "count_all_first", "count_all_sum", "part")
        rows = zip(*[out[c].to_pylist() for c in names], strict=True)
        text = [f"{d},{m},{g},{x},{'' if low is None else low},{k},{n},{part}" for d, m, g, x, low, k, n, part in rows]
        return pa.RecordBatch.from_arrays([out["key"].combine_chunks(), pa.array(text, pa.string())], names=["key", "row"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MERGED_ROWS:
            yield flush()
    if held:
        yield flush()


def settle(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes (text: mask, good, toxic, n, part) that new rows make; the state gets the smallest id of every text.

    The state of a text is this id and the rows that have it: one, unless the table repeats an id.
    """
    known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    change: Counter = Counter()
    touched = False

    def count(mask: int, copy: int, row: list, n: int) -> None:
        change[mask | copy, *row] += n

    for frame in frames:
        for text in frame["row"].tolist():
            digest, mask, good, toxic, first, n_first, n, part = text.split(",", 7)
            mask, n, n_first, row = int(mask), int(n), int(n_first), [good, toxic, part]
            if not first:  # rows without an id
                count(mask, 0, row, n)
                continue
            first, touched = int(first), True
            low, holders = known.get(digest, (None, []))
            if low is None or first < low:
                for *other, n_other in holders:
                    count(mask, 0, other, -n_other)
                    count(mask, COPY, other, n_other)
                low, holders = first, []
            if first == low:
                holders.append([*row, n_first])
                known[digest] = [low, holders]
                count(mask, 0, row, n_first)
                n -= n_first
            count(mask, COPY, row, n)
    if touched:
        state.update((json.dumps(known, separators=(",", ":")),))
    cells = [f"{mask},{good},{toxic},{n},{part}" for (mask, good, toxic, part), n in change.items() if n]
    if cells:
        yield pd.DataFrame({"change": cells})


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while a stream starts, which keeps them; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_bytes(spark: SparkSession) -> int:
    """Input of one micro-batch."""
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(LEAST_BYTES, WAVES * split * spark.sparkContext.defaultParallelism)


def keys_for(spark: SparkSession, path: str) -> int:
    """Number of keys for the table: in proportion to its bytes, so that a key has as many texts at every size."""
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0]
    return 1 + (size or 0) // KEY_BYTES


COUNTER = "part string, mask int, n long, n_good long, n_toxic long"


def counters(spark: SparkSession, path: str, labels: DataFrame, bytes_a_batch: int | None = None) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of the table at ``path``, after its last micro-batch."""
    schema = spark.read.parquet(path).schema
    source = f"{path[:-1]}[{path[-1]}]"  # a pattern for this one name: a stream's plain path must be a folder
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_a_batch or batch_bytes(spark)))
    stream = stream.parquet(source)
    key = (F.conv(F.substring("digest", 1, 15), 16, 10).cast("long") % keys_for(spark, path)).alias("key")
    rows = masked(stream, labels).select(key, *GROUP, "doc_id").mapInArrow(merge_copies, "key long, row string")
    changes = rows.groupBy("key").applyInPandasWithState(settle, "change string", "held string", "update", "NoTimeout")
    cells = F.split("change", ",", 5)
    numbers = [cells[k].cast("long").alias(name) for k, name in enumerate(("mask", "good", "toxic", "n"))]
    changes = changes.select(cells[4].alias("part"), *numbers)
    out = work_dir(spark, "filter-counters")
    spark.createDataFrame([], COUNTER).write.parquet(f"{out}/none")

    def add(batch: DataFrame, number: int) -> None:
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good")]
        sums.append(F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))
        batch.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(*sums).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    with settings(spark, STORE):
        query = (
            changes.writeStream.outputMode("update").foreachBatch(add).trigger(availableNow=True)
            .option("checkpointLocation", work_dir(spark, "filter-stream")).start()
        )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    found = spark.read.schema(COUNTER).option("recursiveFileLookup", "true").parquet(out)
    total = found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])
    return total.filter("n <> 0")


def all_orders(counted: DataFrame) -> DataFrame:
    """The report: for every part, order of the filters and step, what the step keeps and removes."""
    spark, bits = counted.sparkSession, {f: 1 << k for k, f in enumerate(FILTERS)}
    situations = sorted({(sum(bits[f] for f in o[:k]), bits[o[k]]) for o in itertools.permutations(FILTERS) for k in range(5)})
    pairs = F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(b).alias("bit")) for p, b in situations])
    each = counted.select("part", "mask", "n", "n_good", "n_toxic", F.inline(pairs))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("prior")) != 0
    here = fails & ~earlier

    def total(condition: Column, value: Column | str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(F.lit(0))).cast("long")

    # of the 120 orders, a filter comes first among k failed ones in 120 / k
    share = F.col("n") * F.floor(F.lit(120) / F.bit_count("mask"))
    at = each.groupBy("part", "prior", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here, "n_good").alias("good_lost"),
        total(here, "n_toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    steps = [
        ("".join(o), k + 1, sum(bits[f] for f in o[:k]), bits[o[k]]) for o in itertools.permutations(FILTERS) for k in range(5)
    ]
    named = spark.createDataFrame(steps, "filter_order string, step int, prior int, bit int")
    joined = at.join(F.broadcast(named), ["prior", "bit"])  # 600 rows
    return joined.drop("prior", "bit").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


SQL = r"""
WITH letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s.step::INTEGER AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INTEGER AS prior
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM texts),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN words.doc_id > low THEN 16 ELSE 0 END) AS mask
  FROM words LEFT JOIN flags ON words.doc_id = flags.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM masks GROUP BY 1, 2)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(x) FILTER (mask & bit <> 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counted, steps GROUP BY part, filter_order, step, bit, prior
"""


@common.query("op12_filter_audit", SQL)
def op12_filter_audit(spark, sf_dir):
    labels = common.table(spark, sf_dir, "labels")
    return all_orders(counters(spark, f"{sf_dir}/documents.parquet", labels))
