"""Language identification by naive Bayes over character trigrams, fitted in closed form, scored inside the row.

A trigram lies in a word with a blank on both sides; its bucket follows from its three code points.  Words are counted
per language before they are cut into trigrams, so fitting shuffles words and a few counts for each language, and the
driver sees one number for each language and bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.session import compute_once

#: Buckets of trigrams, and factors of the first two code points.
BUCKETS, FACTORS = 4096, (961, 31)
BLANK = ord(" ")


def letters(text: Column) -> Column:
    """Lower-cased words of letters with single blanks; URLs are out."""
    return F.trim(F.regexp_replace(F.lower(T.remove_urls(text)), r"[^\p{L}]+", " "))


def trigrams(words: Column) -> Column:
    """Buckets of the trigrams of blank-separated words."""

    def of_codes(codes: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(1), F.size(codes) - 2), lambda i: F.get(codes, i) != BLANK)
        return F.transform(
            inner, lambda i: (F.get(codes, i - 1) * FACTORS[0] + F.get(codes, i) * FACTORS[1] + F.get(codes, i + 1)) % BUCKETS
        )

    padded = F.concat(F.lit(" "), words, F.lit(" "))
    codes = F.transform(F.split(padded, ""), lambda c: F.ascii(c))
    return F.when(words != "", F.flatten(F.transform(F.array(codes), of_codes)))


def fit(df: DataFrame, text: str, language: str) -> dict[str, list[float]]:
    """Log-probabilities of all buckets for each language, with add-one smoothing."""
    words = df.filter(F.col(language).isNotNull()).select(F.col(language).alias("_l"), F.explode(F.split(letters(F.col(text)), " ")).alias("_w"))
    counted = words.filter("_w <> ''").groupBy("_l", "_w").agg(F.count("*").alias("_n"))
    grams = counted.select("_l", "_n", F.explode(trigrams(F.col("_w"))).alias("_g"))
    found = grams.groupBy("_l", "_g").agg(F.sum("_n").alias("_n")).collect()  # BUCKETS rows of a language at most
    counts: dict[str, list[int]] = {}
    for r in found:
        counts.setdefault(r["_l"], [0] * BUCKETS)[r["_g"]] = r["_n"]
    return {g: [math.log((n + 1) / (sum(own) + BUCKETS)) for n in own] for g, own in sorted(counts.items())}


def identify(df: DataFrame, model: dict[str, list[float]], text: str = "original_comment", min_chars: int = 10) -> DataFrame:
    """Adds ``language`` and ``language_score``, the posterior of the winner when all languages are equally likely.

    ``und`` with score 0 for texts under ``min_chars`` characters without URLs, or without a letter.  Ties go to the
    first language in alphabetical order.
    """
    df = compute_once(df, {"_letters": letters(F.col(text)), "_chars": F.length(T.collapse_spaces(T.remove_urls(F.col(text))))})

    def total(grams: Column, weights: list[float]) -> Column:
        table = F.expr("cast(split('" + ",".join(map(repr, weights)) + "', ',') as array<double>)")  # folded to a literal
        return F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g))

    def sums(grams: Column) -> Column:
        return F.struct(*[total(grams, weights).alias(f"_s{k}") for k, weights in enumerate(model.values())])

    grams = F.coalesce(trigrams(F.col("_letters")), F.array().cast("array<int>"))
    scored = df.select(*[c for c in df.columns if c != "_letters"], (F.col("_letters") != "").alias("_any"), F.inline(F.transform(F.array(grams), sums)))
    names = [f"_s{k}" for k in range(len(model))]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0]) if names else F.lit(None).cast("double")
    winner = F.coalesce(*[F.when(F.col(n) == best, F.lit(g)) for n, g in zip(names, model)], F.lit("und"))
    share = 1 / sum((F.exp(F.col(n) - best) for n in names), F.lit(0.0)) if names else F.lit(0.0)
    known = (F.col("_chars") >= min_chars) & F.col("_any") & F.lit(bool(model))
    found = {
        "language": F.when(known, winner).otherwise("und"),
        "language_score": F.when(known, share).otherwise(F.lit(0.0)),
    }
    return compute_once(scored, found).drop("_chars", "_any", *names)
