"""Linguistic features and scores of a comment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.functions import text as T


def with_features(df: DataFrame, text: str = "original_comment", grammar_errors: str | None = None) -> DataFrame:
    """Adds word counts, averages, Flesch score, rough and enhanced score.

    The word list is a column of its own, read by the features above it, so the
    text is split once per row.  ``grammar_errors`` names an optional input column.
    """
    t = F.col(text)
    counted = df.withColumns(
        {
            "_words": T.words(t),
            "uppercase_proportion": T.uppercase_share(t),
            "repeated_chars_count": T.repeated_runs(t),
            "readability_flesch": T.flesch_reading_ease(t),
        }
    )
    measured = counted.withColumns(
        {
            "avg_word_length": T.average_word_length(F.col("_words")),
            "lexical_diversity": T.lexical_diversity(F.col("_words")),
        }
    )
    average, diversity = F.col("avg_word_length"), F.col("lexical_diversity")
    upper, repeats = F.col("uppercase_proportion"), F.col("repeated_chars_count")
    errors = F.coalesce(F.col(grammar_errors), F.lit(0)) if grammar_errors else F.lit(0)
    scores = {
        "rough_language_score": T.rough_score(average, diversity, upper, repeats),
        "enhanced_language_score": T.enhanced_score(
            F.col("readability_flesch"), errors, average, diversity, upper, repeats
        ),
    }
    return measured.withColumns(scores).drop("_words")


def text_metrics(df: DataFrame, text: str = "original_comment") -> DataFrame:
    """Adds the metrics over words of two or more characters; all zero for a text without such words."""
    t = F.col(text)
    counted = df.withColumns(
        {"_words": T.words(t, 2), "_upper": T.uppercase_share(t), "_runs": T.repeated_runs(t)}
    )
    some = F.size("_words") > 0
    return counted.withColumns(
        {
            "word_count": F.size("_words"),
            "avg_len": T.average_word_length(F.col("_words")),
            "diversity": T.lexical_diversity(F.col("_words")),
            "upper": F.when(some, F.col("_upper")).otherwise(0.0),
            "runs": F.when(some, F.col("_runs")).otherwise(0),
        }
    ).drop("_words", "_upper", "_runs")
