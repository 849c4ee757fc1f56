"""Row filters and label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS = 3, 10_000
FIRST_YEAR, LAST_YEAR = 2005, 2025


def parsed(column: Column | str) -> Column:
    """Timestamp without zone, null where the string is no date."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("timestamp_ntz")


def length_between(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    return F.length(text).between(low, high)


def year_between(ts: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    return F.year(ts).between(first, last)


def validated(df: DataFrame, text: str = "original_comment", date: str = "published_at") -> DataFrame:
    """Comments with a text of sane length and a date in range; missing labels become 'unknown'."""
    kept = (
        df.filter(F.col(text).isNotNull() & F.col(date).isNotNull())
        .filter(length_between(F.col(text)))
        .withColumn(date, parsed(date))
        .filter(year_between(F.col(date)))
    )
    labels = [c for c in ("spam_label", "emotion_label") if c in df.columns]
    return kept.fillna("unknown", labels) if labels else kept


def removal_report(df: DataFrame, keep: Column) -> DataFrame:
    """total, kept, removed and removal rate in one pass."""
    keep = F.coalesce(keep, F.lit(False))
    counts = df.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"))
    return counts.select(
        "total",
        "kept",
        (F.col("total") - F.col("kept")).alias("removed"),
        F.round(F.try_divide((F.col("total") - F.col("kept")) * 100.0, F.col("total")), 6).alias("removed_pct"),
    )


def english_ham_or_foreign(df: DataFrame, prediction: str, language: str = "detected_language") -> DataFrame:
    """Drops predicted spam among English rows; every other language is kept."""
    foreign = F.coalesce(F.col(language), F.lit("unknown")) != "en"
    return df.filter(foreign | (F.col(prediction) == 0))


def mapped(code: Column, labels: dict, default: str) -> Column:
    """Code to label, ``default`` for codes without one."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(pairs, code), F.lit(default))
