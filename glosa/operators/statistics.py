"""Counts over time and labels, trends, shares, pivots, frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.functions import emoji
from glosa.functions import text as T

PERIODS = {"D": "yyyy-MM-dd", "M": "yyyy-MM", "Y": "yyyy"}


def period_counts(df: DataFrame, ts: str = "published_at", freq: str = "M", by: list[str] = ()) -> DataFrame:
    """Rows per day, month or year; only periods that occur."""
    period = F.date_format(ts, PERIODS[freq]).alias("period")
    return df.filter(F.col(ts).isNotNull()).groupBy(*by, period).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def share(n: Column, total: Column) -> Column:
    """Percentage, null where the total is zero."""
    return F.round(F.try_divide(n * 100.0, total), 6)


def temporal_summary(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Number of periods, peak period (earliest on ties) and count, mean per period."""
    numbered = counts.withColumn("_age", -F.replace("period", F.lit("-"), F.lit("")).cast("long"))
    return numbered.groupBy(*by).agg(
        F.count("*").alias("periods"),
        F.max_by("period", F.struct("n", "_age")).alias("peak_period"),
        F.max("n").alias("peak_count"),
        F.round(F.avg("n"), 6).alias("mean_per_period"),
    )


def trend(counts: DataFrame, by: list[str] = (), period: str = "period") -> DataFrame:
    """increasing / decreasing / stable by the correlation of count and period number.

    Works on per-period counts, so a group has as many rows as there are periods.
    A constant series has no correlation and is stable.
    """
    keys = list(by) or [F.lit(1)]
    numbered = counts.withColumns(
        {
            "_x": F.row_number().over(W.partitionBy(*keys).orderBy(period)).cast("double"),
            "_sd": F.stddev_pop("n").over(W.partitionBy(*keys)),
        }
    )
    varying = F.when(F.col("_sd") > 0, F.col("n").cast("double"))
    # a single row has no spread either, so corr only ever sees two or more distinct values
    summary = numbered.withColumn("_y", varying).withColumn("_x", F.when(F.col("_sd") > 0, F.col("_x")))
    grouped = summary.groupBy(*by).agg(F.count("*").alias("periods"), F.corr("_x", "_y").alias("_r"))
    label = (
        F.when(F.col("periods") < 2, "insufficient_data")
        .when(F.col("_r") > 0.3, "increasing")
        .when(F.col("_r") < -0.3, "decreasing")
        .otherwise("stable")
    )
    return grouped.select(*by, "periods", label.alias("trend"), F.round("_r", 6).alias("r"))


def seasonality(monthly: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean count per calendar month: peak month and spread, given twelve or more periods."""
    month = F.substring("period", 6, 2).cast("int").alias("month")
    means = monthly.groupBy(*by, month).agg(F.avg("n").alias("mean"), F.count("*").alias("periods"))
    summary = means.groupBy(*by).agg(
        F.sum("periods").alias("periods"),
        F.max_by("month", F.struct("mean", -F.col("month"))).alias("peak"),
        F.stddev_samp("mean").alias("sd"),
    )
    enough = F.col("periods") >= 12
    return summary.select(
        *by,
        F.when(enough, "detected").otherwise("insufficient_data").alias("pattern"),
        F.when(enough, F.col("peak")).alias("peak_month"),
        F.when(enough, F.round("sd", 6)).alias("seasonal_variation"),
    )


def label_grid(keys: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Every key with every label of a fixed list."""
    return keys.withColumn(column, F.explode(F.array(*[F.lit(x) for x in labels])))


def label_distribution(df: DataFrame, group: str, label: str, labels: list[str]) -> DataFrame:
    """Share of each label per group among the labelled rows; labels that do not occur have 0."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    grid = label_grid(counts.select(group).distinct(), label, labels)
    filled = grid.join(counts, [group, label], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy(group))
    return filled.select(group, label, "n", share(F.col("n"), total).alias("pct"))


def emotion_by_year(df: DataFrame, labels: list[str], year: str = "year", label: str = "emotion_label") -> DataFrame:
    """One row per year, one column per label: its share of the year's labelled rows."""
    counts = df.groupBy(year).pivot(label, labels).count().fillna(0, labels)
    total = sum((F.col(x) for x in labels), F.lit(0))
    return counts.select(year, *[share(F.col(x), total).alias(x) for x in labels])


def share_trend(df: DataFrame, group: str, labels: list[str], label: str = "emotion_label") -> DataFrame:
    """Share of some labels per group and year; rows without a label count in the total."""
    counts = df.groupBy(group, "year").agg(
        F.count("*").alias("total"), *[F.count_if(F.col(label) == x).alias(x) for x in labels]
    )
    return counts.unpivot([group, "year", "total"], labels, "emotion", "n").withColumn(
        "pct", share(F.col("n"), F.col("total"))
    )


def volume_by_year(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    return df.groupBy("year").pivot(group, values).count().fillna(0, values)


def emoji_counts(df: DataFrame, text: str, by: list[str] = ()) -> DataFrame:
    """Occurrences per emoji code point, skin tones removed; only the emoji string is exploded."""
    emojis = emoji.strip_tones(emoji.extract(F.col(text)))
    only = df.select(*by, emojis.alias("_emojis")).filter("_emojis <> ''")
    single = only.select(*by, F.explode(emoji.characters(F.col("_emojis"))).alias("emoji"))
    return single.groupBy(*by, "emoji").agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, cleaned: Column, stop_words, min_length: int, by: list[str] = ()) -> DataFrame:
    """Occurrences per word of a cleaned text, without stop words and short words."""
    tokens = df.select(*by, F.explode(F.split(cleaned, f"[{T.SPACE}]+")).alias("word"))
    kept = tokens.filter((F.length("word") >= min_length) & ~F.col("word").isin(list(stop_words)))
    return kept.groupBy(*by, "word").agg(F.count("*").alias("n"))


def top(df: DataFrame, k: int, *ties: str, n: str = "n") -> DataFrame:
    """The k rows with the highest count."""
    return df.orderBy(F.desc(n), *ties).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, spread_key=None, salts: int = 64) -> DataFrame:
    """First k rows per group.

    With ``spread_key`` the group is cut into ``salts`` parts that are ranked on
    their own first, so that a group holding a large part of all rows is never
    sorted by one task; the second ranking sees at most ``salts * k`` rows.
    """
    if spread_key is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread_key), F.lit(salts)))
        part = W.partitionBy(*group, "_salt").orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).drop("_salt", "_n")
    whole = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k).drop("_n")
