"""Joins: dictionary match, unused rows, annotator alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.functions.membership import filters, may_contain
from glosa.functions.patterns import WORD


def dictionary_match(df: DataFrame, text: str, entries: DataFrame, entry: str) -> DataFrame:
    """Which dictionary entries stand in each text as whole words, one row for each row of ``df`` and entry.

    The dictionary is indexed by the first word of its entries: of a text, only words that a Bloom filter of these
    first words lets pass begin a run, and of their runs, as long as the longest entry, only those that a filter of
    the whole entries lets pass leave the row.  They meet the dictionary in an equi-join, which drops what the
    filters let pass in error.  So the dictionary may be of any size and no text is shuffled.
    """
    n_words = F.size(F.regexp_extract_all(entry, F.lit(f"[{WORD}]+"), F.lit(0)))
    lowered = entries.filter(n_words > 0).select(entry, F.lower(entry).alias("_run"), n_words.alias("_n"))
    longest = lowered.agg(F.max("_n")).first()[0] or 1
    bloom = filters(lowered, {"first": F.regexp_extract("_run", f"[{WORD}]+", 0), "whole": F.col("_run")})

    def runs(pieces):
        """Runs of words with their separators, of an array in which words and separators take turns."""
        first = F.when(F.get(pieces, F.lit(0)).rlike(f"^[{WORD}]"), 1).otherwise(2)
        starts = F.when(F.size(pieces) >= first, F.sequence(first, F.size(pieces), F.lit(2)))
        starts = F.filter(starts, lambda i: may_contain(bloom["first"], F.get(pieces, i - 1)))
        tails = F.transform(starts, lambda i: F.slice(pieces, i, F.lit(2 * longest - 1)))
        joined = F.transform(tails, lambda tail: F.transform(
            F.sequence(F.lit(1), F.size(tail), F.lit(2)), lambda k: F.array_join(F.slice(tail, F.lit(1), k), "")
        ))
        return F.filter(F.array_distinct(F.flatten(joined)), lambda run: may_contain(bloom["whole"], run))

    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))
    found = F.flatten(F.transform(F.array(pieces), runs))  # the pieces stay a variable
    keyed = df.select(*[c for c in df.columns if c != text], F.explode(found).alias("_run"))
    return keyed.join(lowered.drop("_n"), "_run").drop("_run")


def unused(df: DataFrame, used: DataFrame, key: str, language: str | None = "en") -> DataFrame:
    """Rows whose key is not among the used keys, in one language."""
    rows = df.filter(F.col("detected_language") == language) if language else df
    return rows.join(used.select(key), key, "left_anti")


def aligned_annotations(a: DataFrame, b: DataFrame, key: str = "comment_id", label: str = "label") -> DataFrame:
    """Pairs of labels of the same comment, both present and not empty."""
    left = a.select(key, F.col(label).alias("label_a")).filter("label_a <> ''")
    right = b.select(key, F.col(label).alias("label_b")).filter("label_b <> ''")
    return left.join(right, key)
