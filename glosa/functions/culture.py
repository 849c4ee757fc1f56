"""Cultural identity signals of one comment: keyword, pattern and context steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.functions.patterns import bounded, contains_word, hits, matches, pattern_hits
from glosa.session import compute_once
from glosa.vocab import words as vocab

ALL_BASIC = [w for c in vocab.CATEGORIES for w in vocab.CULTURAL_BASIC[c]]


def short(category: str) -> str:
    """'Ethnic Identity' -> 'ethnic'."""
    return category.split()[0].lower()


def mentions_any(text: Column) -> Column:
    return contains_word(text, ALL_BASIC)


def first_keyword(text: Column, keywords) -> Column:
    """First keyword in list order that stands in the text as a whole word."""

    def search(lowered: Column) -> Column:
        return F.coalesce(
            *[
                F.when(F.contains(lowered, F.lit(k)) & lowered.rlike(bounded(k)), F.lit(k))
                for k in keywords
            ]
        )

    return F.get(F.transform(F.array(F.lower(text)), search), 0)


def with_signals(df, text: str = "original_comment"):
    """Adds, per category, ``<c>_detected/_confidence/_method/_matches`` and the overall score.

    Each step reads columns of the step before, so every list is evaluated once
    per row; no row loop and no join.
    """
    df = compute_once(df, {"_low": F.lower(text)})
    lowered = F.col("_low")
    counts = {}
    for category in vocab.CATEGORIES:
        c = short(category)
        counts[f"{c}_n"] = hits(lowered, vocab.CULTURAL_DIRECT[category])
        counts[f"{c}_words"] = matches(lowered, vocab.CULTURAL_DIRECT[category], "; ")
        counts[f"{c}_indicators"] = hits(lowered, vocab.CULTURAL_INDICATORS[category])
        counts[f"{c}_patterns"] = pattern_hits(lowered, vocab.CULTURAL_PATTERNS[category])
        counts[f"{c}_boosters"] = hits(lowered, vocab.CONTEXT_BOOSTERS[category])
    df = df.withColumns(counts).drop("_low")

    steps = {}
    for category in vocab.CATEGORIES:
        c = short(category)
        n_words, n_patterns = F.col(f"{c}_n"), F.col(f"{c}_patterns")
        by_word = F.when(
            n_words > 0, F.least(F.lit(1.0), n_words * 0.8 + F.col(f"{c}_indicators") * 0.2)
        ).otherwise(F.lit(0.0))
        by_pattern = F.when(n_patterns > 0, F.lit(0.6) + n_patterns * 0.1).otherwise(F.lit(0.0))
        pattern_wins = by_pattern > by_word
        base = F.when(pattern_wins, F.least(F.lit(1.0), by_pattern)).otherwise(by_word)
        detected = (n_words > 0) | (n_patterns > 0)
        boosted = detected & (F.col(f"{c}_boosters") > 0)
        steps[f"{c}_detected"] = detected
        steps[f"{c}_confidence"] = F.when(
            boosted, F.least(F.lit(1.0), base + F.col(f"{c}_boosters") * 0.1)
        ).otherwise(base)
        method = F.when(pattern_wins, "pattern").when(n_words > 0, "keyword").otherwise("")
        steps[f"{c}_method"] = F.concat(method, F.when(boosted, "+context").otherwise(""))
        steps[f"{c}_matches"] = F.when(
            pattern_wins, F.concat(F.lit("patterns: "), n_patterns.cast("string"))
        ).otherwise(F.col(f"{c}_words"))
    df = df.withColumns(steps)

    names = [short(c) for c in vocab.CATEGORIES]
    n = sum((F.col(f"{c}_detected").cast("int") for c in names), F.lit(0))
    total = sum((F.col(f"{c}_confidence") for c in names), F.lit(0.0))
    bonus = F.least(F.lit(0.2), (n - 1) * 0.1)
    overall = F.when(n > 0, F.least(F.lit(1.0), total / n + bonus)).otherwise(F.lit(0.0))
    scratch = [f"{c}_{s}" for c in names for s in ("n", "words", "indicators", "patterns", "boosters")]
    return compute_once(df.drop(*scratch), {"n_categories": n, "overall_score": overall})


def detected_only(df):
    """Rows with at least one category."""
    return df.filter(F.col("n_categories") > 0)
