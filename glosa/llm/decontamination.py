"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training windows.

Benchmark items become windows of ``WINDOW`` words (a shorter item is one window of all its words).  Their
number is counted on Spark first.  Up to ``BLOCK_WINDOWS`` of them go to the executors as one broadcast; a
larger benchmark is dealt into blocks by window hash, each block is broadcast and scanned in turn, and a
document's hits are the union.  In a task, words become numbers of the block's vocabulary, windows of
numbers get rolling hashes, hashes are looked up in a sorted table, and every hit is compared word by word.

Defined results: null or empty texts and items have no words; repeated items count once by their id, items
with a null id mark words but are listed as an empty string; repeated documents are judged each; equal
windows of several items hit them all; further columns are kept or ignored but never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm import common

#: Fixed values of the contract: words of a window; a document is contaminated from 1 in 20 words on.
WINDOW, ONE_IN = 13, 20
#: Windows (with their items) that one broadcast may hold: about 150 bytes each.
BLOCK_WINDOWS = 200_000
#: Words that are looked up at once.
SCAN_WORDS = 1_000_000

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<first: long, after: long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(common.LETTERS_TABLE).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, line): each line is the words of one window joined by spaces."""

    @F.pandas_udf("array<string>")
    def lines(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            out = []
            for text in batch:
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                n = max(1, len(words) - window + 1) if words else 0
                out.append(list(dict.fromkeys(" ".join(words[i : i + window]) for i in range(n))))
            yield pd.Series(out, dtype=object)

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, F.explode(lines(common.text_or_empty())).alias("line")).distinct()


def blocks_of(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> list[dict]:
    """Driver-side blocks {line: [items]}, of about ``most`` windows each at the most."""
    rows = item_windows(benchmark, window)
    count = rows.count()
    blocks = max(1, -(-count // most))
    out = []
    for k in range(blocks):
        part: dict[str, list[str]] = {}
        chosen = rows.filter(F.pmod(F.xxhash64("line", "item"), F.lit(blocks)) == k)
        for line, item in sorted((r.line, r.item) for r in chosen.collect()):
            part.setdefault(line, []).append(item)
        out.append(part)
    return out


class Scanner:
    """Looks for the windows of one block in many texts."""

    def __init__(self, block: dict[str, list[str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.by_width: dict[int, tuple] = {}
        widths: dict[int, list] = {}
        for line, items in block.items():
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in line.encode().split()]
            widths.setdefault(len(numbers), []).append((numbers, items))
        for width, rows in widths.items():
            numbers = np.array([r[0] for r in rows], np.uint64)
            hashes = np.array([common.rolling(n, width)[0] for n in numbers], np.uint64)
            order = np.argsort(hashes, kind="stable")
            low = np.zeros(1 << 20, bool)
            low[hashes & np.uint64(len(low) - 1)] = True
            self.by_width[width] = hashes[order], numbers[order], [rows[i][1] for i in order], low

    def scan(self, texts: list[list[bytes]]) -> list[tuple[int, np.ndarray, set]]:
        """For each list of words its length, a mask of hit words, and the items found."""
        lengths = [len(t) for t in texts]
        starts = np.cumsum([0] + [n + 1 for n in lengths])  # an unknown word (0) stands between texts
        flat = np.zeros(int(starts[-1]), np.uint64)
        for at, words in zip(starts.tolist(), texts, strict=False):
            flat[at : at + len(words)] = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        edge = np.zeros(len(flat) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for width, (hashes, numbers, owners, low) in self.by_width.items():
            rolled = common.rolling(flat, width)
            maybe = np.flatnonzero(low[rolled & np.uint64(len(low) - 1)])
            if not len(maybe):
                continue
            first = np.searchsorted(hashes, rolled[maybe], side="left")
            last = np.searchsorted(hashes, rolled[maybe], side="right")
            for shift in range(int((last - first).max(initial=0))):  # more than one only if hashes collide
                there = first + shift < last
                at, row = maybe[there], (first + shift)[there]
                same = np.ones(len(at), bool)
                for k in range(width):
                    same &= flat[at + k] == numbers[row, k]
                at, row = at[same], row[same]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                text = np.searchsorted(starts, at, side="right") - 1
                for t, r in np.unique(np.stack([text, row], axis=1), axis=0).tolist():
                    items[t].update(owners[r])
        mask = np.cumsum(edge)[:-1] > 0
        return [(n, mask[s : s + n], found) for n, s, found in zip(lengths, starts.tolist(), items, strict=False)]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, after) of each run of hit words."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def hits(spark: SparkSession, text: Column, blocks: list[dict]) -> Column:
    """Struct of n_words, n_hit, the sorted items found and the spans of hit words, over all blocks."""
    sent = [spark.sparkContext.broadcast(b) for b in blocks]

    def scan_all(scanners, texts):
        found = [s.scan(texts) for s in scanners]
        for per_text in zip(*found, strict=True):
            n = per_text[0][0]
            mask = np.logical_or.reduce([p[1] for p in per_text])
            items = sorted(set().union(*(p[2] for p in per_text)))
            yield n, int(mask.sum()), items, [{"first": a, "after": b} for a, b in runs(mask)]

    @F.pandas_udf(HITS)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.kept()
        scanners = [Scanner(b.value) for b in sent]
        for batch in series:
            rows, texts, size = [], [], 0
            for value in batch:
                texts.append(words_of(value))
                size += len(texts[-1])
                if size > SCAN_WORDS:
                    rows += scan_all(scanners, texts)
                    texts, size = [], 0
            if texts:
                rows += scan_all(scanners, texts)
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return run(F.coalesce(text.cast("string"), F.lit("")))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def find(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans and contaminated for every document."""
    blocks = blocks_of(benchmark, most=most)
    found = docs.select("doc_id", hits(docs.sparkSession, F.col("text"), blocks).alias("hits_"))
    found = found.select("doc_id", "hits_.*")
    return found.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its hit words and what stands between neighbouring hit words."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        import re

        out = []
        for value, own in zip(texts, all_spans, strict=True):
            if value is None or own is None or not len(own):
                out.append(value)
                continue
            places = [m.span() for m in re.finditer(PATTERN, value)]
            kept, at = [], 0
            for span in own:
                kept.append(value[at : places[span["first"]][0]])
                at = places[span["after"] - 1][1]
            out.append("".join([*kept, value[at:]]))
        return pd.Series(out, dtype=object)

    return cut(text.cast("string"), spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", most: int = BLOCK_WINDOWS) -> DataFrame:
    """The table without contaminated documents, or (``remove="spans"``) with hit words cut out of the texts."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    found = hits(docs.sparkSession, common.field("text"), blocks_of(benchmark, most=most))
    rows = common.packed(docs).withColumn("hits_", found)
    if remove == "documents":
        return rows.filter(~contaminated(F.col("hits_.n_hit"), F.col("hits_.n_words"))).select("row_.*")
    text = without_spans(common.field("text"), F.col("hits_.spans"))
    return rows.withColumn("row_", F.col("row_").withField("text", text)).select("row_.*")


SQL = f"""
WITH cut AS (
  SELECT doc_id AS id, 0 AS kind, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT item_id, 1, row_number() OVER (), text FROM benchmark
), listed AS (
  SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS words FROM cut
), grams AS (
  SELECT DISTINCT id AS item, least({WINDOW}, len(words)) AS width,
    array_to_string(words[i : i + least({WINDOW}, len(words)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS i FROM listed WHERE kind = 1 AND len(words) > 0)
), places AS (
  SELECT row, width, i, array_to_string(words[i : i + width - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i
        FROM listed, (SELECT DISTINCT width FROM grams) WHERE kind = 0 AND len(words) >= width)
), found AS (
  SELECT row, places.width, i, item FROM places JOIN grams USING (width, gram)
), marked AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT row, i, width FROM found)) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line
  FROM (SELECT DISTINCT row, coalesce(item::VARCHAR, '') AS item FROM found) GROUP BY row
)
SELECT id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(line, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM listed LEFT JOIN marked USING (row) LEFT JOIN items USING (row) WHERE kind = 0
"""


@common.query("op9_decontamination", SQL)
def op9_decontamination(spark, sf_dir):
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )
