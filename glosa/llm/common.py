"""Pieces that several operators share: table access, registry, word splitting, hashing of words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its DuckDB statement."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Texts in one Arrow batch.  A worker holds a batch as Arrow and as Python strings; Spark's default of 10,000 rows
#: is meant for short cells.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python workers in batches of ``ARROW_ROWS`` rows at the most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, with the session set for texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for; operators that name partitions use it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_kept: dict = {}


def kept(key=None, make: Callable | None = None):
    """What this Python worker keeps from task to task: ``make()`` under a key, or nothing.

    Spark gives the tasks of all operators to the same workers, so one thing is kept at a time: a task that asks for
    another, or calls without a key, lets go of it.
    """
    if key not in _kept:
        _kept.clear()
        if make is None:
            return None
        _kept[key] = make()
    return _kept[key]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row_``, so that added columns cannot clash with names of the table."""
    return docs.select(F.struct("*").alias("row_"))


def field(name: str) -> Column:
    return F.col("row_").getField(name)


# --- words ------------------------------------------------------------------------------------
#: Bytes that end a word ``[^\x20\x09-\x0D]+``; bytes.split() splits at the same six.
SPACES = b" \t\n\r\x0b\x0c"

_lower = bytes(range(256)).lower()
#: Maps A-Z to a-z and every byte outside ``[0-9a-z\x80-\xff]`` to a space: the word rule of op 9 on UTF-8.
LETTERS_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _lower)
#: Maps A-Z to a-z only.
LOWER_TABLE = _lower


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` consecutive values: a sum of powers, then scrambled."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for k in range(width):
        out = out * base + values[k : k + n]
    return mix(out)
