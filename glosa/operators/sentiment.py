"""Sentiment by multinomial naive Bayes from a few seed sentences, in closed form."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.functions.patterns import SPACE
from glosa.session import compute_once
from glosa.vocab.words import SENTIMENT_SEED


def _tokens(sentence: str) -> list[str]:
    letters = "".join(c for c in sentence.lower() if c.isalpha() or c.isspace())
    return [w for w in letters.split() if len(w) > 1]


def weights(seed=SENTIMENT_SEED) -> tuple[float, dict[str, float]]:
    """Prior log-odds of 'positive' and the log-odds each known word adds (add-one smoothing).

    The seed is a handful of sentences; the model is a literal in the plan.
    """
    counts = {"positive": Counter(), "negative": Counter()}
    for sentence, label in seed:
        counts[label].update(_tokens(sentence))
    words = sorted(counts["positive"] | counts["negative"])
    totals = {label: sum(c.values()) + len(words) for label, c in counts.items()}
    n = Counter(label for _, label in seed)
    prior = math.log(n["positive"] / n["negative"])

    def odds(word: str) -> float:
        p = (counts["positive"][word] + 1) / totals["positive"]
        q = (counts["negative"][word] + 1) / totals["negative"]
        return math.log(p / q)

    return prior, {w: odds(w) for w in words}


def log_odds(text: Column, seed=SENTIMENT_SEED) -> Column:
    prior, odds = weights(seed)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])
    letters = F.regexp_replace(F.lower(text), f"[^\\p{{L}}{SPACE}]", "")
    # only words of the model leave the text; the rest add nothing
    known = F.regexp_extract_all(
        letters, F.lit(f"(?<![^{SPACE}])(?:{'|'.join(odds)})(?![^{SPACE}])"), F.lit(0)
    )
    return F.aggregate(known, F.lit(prior), lambda acc, w: acc + F.element_at(table, w))


def scored(df: DataFrame, text: str = "original_comment") -> DataFrame:
    """Adds ``sentiment``, ``p_positive`` and ``p_negative``; ties go to 'negative'."""
    odds = compute_once(df, {"_odds": log_odds(F.col(text))})
    capped = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("_odds")))
    positive = 1 / (1 + F.exp(-capped))
    return odds.withColumns(
        {
            "sentiment": F.when(F.col("_odds") > 0, "positive").otherwise("negative"),
            "p_positive": F.round(positive, 6),
            "p_negative": F.round(1 - positive, 6),
        }
    ).drop("_odds")
