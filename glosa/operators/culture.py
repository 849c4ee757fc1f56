"""Summaries of cultural identity signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.functions import culture
from glosa.functions.culture import short
from glosa.functions.patterns import occurrences
from glosa.operators.statistics import share, trend
from glosa.session import compute_once
from glosa.vocab.words import CATEGORIES, CULTURAL_BASIC

NAMES = [short(c) for c in CATEGORIES]


def labelled(df: DataFrame, text: str = "original_comment") -> DataFrame:
    """Comments with a category keyword as a whole word; per category the first keyword, else null."""
    first = {short(c): culture.first_keyword(F.col(text), CULTURAL_BASIC[c]) for c in CATEGORIES}
    any_found = F.coalesce(*[F.col(short(c)) for c in CATEGORIES]).isNotNull()
    return compute_once(df, first).filter(any_found)


def signals(df: DataFrame) -> DataFrame:
    """Comments with at least one detected category, scored in the keyword, pattern and context steps."""
    return culture.detected_only(culture.with_signals(df))


def by_category(scored: DataFrame, *keep: str) -> DataFrame:
    """One row per comment and detected category: confidence, method, matches."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.col(f"{c}_detected").alias("detected"),
                F.col(f"{c}_confidence").alias("confidence"), F.col(f"{c}_method").alias("method"),
                F.col(f"{c}_matches").alias("matches"),
            )
            for c in NAMES
        ]
    )
    return scored.select(*keep, F.inline(rows)).filter("detected").drop("detected")


def category_summary(scored: DataFrame) -> DataFrame:
    """Per category: detected rows, mean confidence, rows above 0.8."""
    return by_category(scored).groupBy("category").agg(
        F.count("*").alias("detected"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
    )


def category_methods(scored: DataFrame) -> DataFrame:
    return by_category(scored).groupBy("category", "method").agg(F.count("*").alias("n"))


def top_matches(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k terms matched most often per category; ranked over counts, not rows."""
    terms = by_category(scored).select("category", F.explode(F.split("matches", ";")).alias("term"))
    counts = terms.select("category", F.trim("term").alias("term")).groupBy("category", "term").agg(
        F.count("*").alias("n")
    )
    order = W.partitionBy("category").orderBy(F.desc("n"), "term")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def yearly_confidence(scored: DataFrame) -> DataFrame:
    """Per category and year: detected rows and mean confidence."""
    rows = by_category(scored, F.year("published_at").alias("year"))
    return rows.groupBy("category", "year").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


def yearly_trend(yearly: DataFrame) -> DataFrame:
    """Per category: peak year and trend."""
    peaks = yearly.groupBy("category").agg(
        F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year")
    )
    return trend(yearly, ["category"], "year").join(peaks, "category")


def detection_quality(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"),
        F.round(F.avg("overall_score"), 6).alias("mean_score"),
        F.count_if(F.col("overall_score") > 0.8).alias("high_confidence"),
        F.count_if(F.col("n_categories") > 1).alias("multi_category"),
    )


def intersections(scored: DataFrame) -> DataFrame:
    """Rows in which both categories of a pair are detected; one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1:]]
    counts = scored.agg(
        *[F.count_if(F.col(f"{a}_detected") & F.col(f"{b}_detected")).alias(f"{a} + {b}") for a, b in pairs]
    )
    return counts.unpivot([], [f"{a} + {b}" for a, b in pairs], "pair", "n")


def diversity(scored: DataFrame) -> DataFrame:
    """Shannon entropy of the category shares over its maximum; 0 for a single category."""
    counts = by_category(scored).groupBy("category").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))
    total = shares.agg(F.count("*").alias("k"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return total.select(
        F.col("k").alias("categories"),
        F.when(F.col("k") > 1, F.round(F.col("h") / F.log2(F.col("k").cast("double")), 6))
        .otherwise(0.0)
        .alias("diversity"),
    )


def yearly_categories(rows: DataFrame, group: str = "video") -> DataFrame:
    """Per group and year: labelled rows, rows per category and its share of the labelled rows."""
    counts = rows.groupBy(group, F.year("published_at").alias("year")).agg(
        F.count("*").alias("total"), *[F.count(c).alias(c) for c in NAMES]
    )
    return counts.select("*", *[share(F.col(c), F.col("total")).alias(f"{c}_pct") for c in NAMES])


def category_totals(yearly: DataFrame, group: str = "video") -> DataFrame:
    """Per group and category: total, share of all categories, mean yearly percentage."""
    long = yearly.select(
        group,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), F.col(f"{c}_pct").alias("pct"))
                    for c in NAMES
                ]
            )
        ),
    )
    sums = long.groupBy(group, "category").agg(
        F.sum("n").alias("total"), F.round(F.avg("pct"), 1).alias("mean_yearly_pct")
    )
    return sums.withColumn("share_pct", share(F.col("total"), F.sum("total").over(W.partitionBy(group))))


def dominant_category(totals: DataFrame, group: str = "video") -> DataFrame:
    """Category with the highest total per group; ties go to the first in list order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in NAMES]), F.col("category"))
    best = F.max_by(F.struct("category", "total", "mean_yearly_pct"), F.struct("total", -rank))
    return totals.groupBy(group).agg(best.alias("best")).select(group, "best.*")


def keyword_occurrences(rows: DataFrame, by: list[str], text: str = "original_comment") -> DataFrame:
    """Substring occurrences of each ethnic and religious keyword in rows of its category.

    Every keyword is a column of one aggregation; the few result columns are then
    turned into rows.
    """
    lowered = rows.withColumn("_low", F.lower(text))
    names, sums = [], []
    for category in CATEGORIES[:2]:
        c = short(category)
        for word in CULTURAL_BASIC[category]:
            names.append(f"{c}:{word}")
            sums.append(F.sum(F.when(F.col(c).isNotNull(), occurrences(F.col("_low"), word)).otherwise(0)).alias(names[-1]))
    wide = lowered.groupBy(*by).agg(*sums)
    long = wide.unpivot(by, names, "keyword", "n") if by else wide.unpivot([], names, "keyword", "n")
    return long.withColumns(
        {"category": F.substring_index("keyword", ":", 1), "keyword": F.substring_index("keyword", ":", -1)}
    )


def keyword_documents(df: DataFrame, vocabulary: dict, text: str = "original_comment") -> DataFrame:
    """Rows containing each keyword, whatever else they contain."""
    lowered = df.withColumn("_low", F.lower(text))
    names = [f"{short(c)}:{w}" for c, ws in vocabulary.items() for w in ws]
    counts = lowered.agg(
        *[F.count_if(F.contains("_low", F.lit(n.split(":")[1]))).alias(n) for n in names]
    )
    return counts.unpivot([], names, "keyword", "n").withColumns(
        {"category": F.substring_index("keyword", ":", 1), "keyword": F.substring_index("keyword", ":", -1)}
    )


def dataset_comparison(every: DataFrame, group: str = "video") -> DataFrame:
    """Per dataset: rows, rows with a category, share; ``every`` keeps the rows without a category."""
    counts = every.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(F.col("n_categories") > 0).alias("detected")
    )
    return counts.withColumn("pct", share(F.col("detected"), F.col("total")))
