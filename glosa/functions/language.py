"""Language identification by voting of common function words, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.functions.patterns import any_bounded
from glosa.session import compute_once
from glosa.vocab.words import LANGUAGE_WORDS


def votes(lowered: Column, words) -> Column:
    """Occurrences of the words in an already lower-cased text."""
    return F.regexp_count(lowered, F.lit(any_bounded(words, lowered=True)))


def detect(df, text: str = "original_comment", language_words=None, min_chars: int = 10):
    """Adds ``language`` and ``language_score`` (share of the winning language's votes).

    ``und`` for texts under ``min_chars`` characters without URLs, or without a
    single vote.  Ties go to the first language in alphabetical order.
    """
    language_words = language_words or LANGUAGE_WORDS
    langs = sorted(language_words)
    df = compute_once(df, {"_low": F.lower(T.collapse_spaces(T.remove_urls(F.col(text))))})
    counted = df.withColumns(
        {"_chars": F.length("_low"), **{f"_v_{g}": votes(F.col("_low"), language_words[g]) for g in langs}}
    ).drop("_low")
    total = sum((F.col(f"_v_{g}") for g in langs), F.lit(0))
    best = F.greatest(*[F.col(f"_v_{g}") for g in langs])
    winner = F.coalesce(*[F.when(F.col(f"_v_{g}") == best, F.lit(g)) for g in langs])
    known = (F.col("_chars") >= min_chars) & (best > 0)
    found = {
        "language": F.when(known, winner).otherwise("und"),
        "language_score": F.when(known, best / total).otherwise(F.lit(0.0)),
    }
    return compute_once(counted, found).drop("_chars", *[f"_v_{g}" for g in langs])


def speaks(df, language: str = "en", at_least: float = 0.8):
    """Rows identified as ``language`` with enough confidence."""
    return df.filter((F.col("language") == language) & (F.col("language_score") >= at_least))
