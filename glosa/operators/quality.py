"""Data quality of a raw comment table: counts, score, recommendations, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.functions import text as T
from glosa.operators.filters import parsed
from glosa.session import side_by_side

SITE_START = "TIMESTAMP_NTZ '2005-01-01 00:00:00'"


# ---------------------------------------------------------------- fixed values
RECOMMENDATIONS = [
    "Dataset '{name}' needs quality improvements",
    "Remove duplicate rows from '{name}'",
    "Handle missing comments in '{name}'",
    "Fix timestamp parsing errors in '{name}'",
]
# ------------------------------------------------------------ end fixed values


def row_digests(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes over all columns, nulls marked."""
    cells = [c for name in df.columns for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, in all columns.

    Only 16 bytes per row are shuffled, after copies have been counted per task.
    """
    groups = df.select(*row_digests(df)).groupBy("_h1", "_h2").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def metrics(df: DataFrame, now: Column, text: str = "original_comment", date: str = "published_at") -> DataFrame:
    """One row of counts from one pass over the table, plus the duplicate count."""
    t, ts = F.col(text), F.col("_ts")
    prepared = df.withColumn("_ts", parsed(date))
    empty = sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in df.columns), F.lit(0))

    def unknown_share(column: str) -> Column:
        return F.try_divide(F.count_if(F.col(column) == "unknown") * 1.0, F.count("*"))

    aggregates = {
        "total": F.count("*"),
        "empty_columns": empty,
        "missing": F.count_if(t.isNull()),
        "short": F.count_if(F.length(t) < 3),
        "long": F.count_if(F.length(t) > 1000),
        "repeats": F.count_if(t.rlike(r"([^\n])\1{5,}")),
        "non_alphabetic": F.count_if(T.non_alphabetic_share(t) > 0.7),
        "unparseable": F.count_if(F.col(date).isNotNull() & ts.isNull()),
        "future": F.count_if(ts > now),
        "too_old": F.count_if(ts < F.expr(SITE_START)),
        "span_days": F.timestamp_diff("DAY", F.min(ts), F.max(ts)),
    }
    for column in ("spam_label", "emotion_label"):
        if column in df.columns:
            aggregates[f"{column}_unknown"] = unknown_share(column)
    if "detected_language" in df.columns:
        language = F.col("detected_language")
        aggregates["one_language"] = F.coalesce(F.min(language) == F.max(language), F.lit(False))
    one = prepared.agg(*[a.alias(n) for n, a in aggregates.items()])
    return side_by_side(one, duplicate_rows(df))


def scored(measured: DataFrame) -> DataFrame:
    """Adds the quality score: 100 less 10 per structural kind of issue, 15 for missing texts,
    10 for unparseable dates, 3 per text warning, 2 per date or label warning; at least 0."""

    def any_of(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False)).cast("int")

    def over(name: str, limit: float) -> Column:
        return F.coalesce(F.col(name) > limit, F.lit(False)).cast("int") if name in measured.columns else F.lit(0)

    structural = (F.col("total") == 0).cast("int") + any_of("duplicates") + any_of("empty_columns")
    texts = any_of("short") + any_of("long") + any_of("repeats") + any_of("non_alphabetic")
    dates = any_of("future") + any_of("too_old") + F.coalesce(F.col("span_days") < 30, F.lit(False)).cast("int")
    labels = over("spam_label_unknown", 0.8) + over("emotion_label_unknown", 0.8)
    if "one_language" in measured.columns:
        labels = labels + F.col("one_language").cast("int")
    score = (
        100.0 - structural * 10 - any_of("missing") * 15 - any_of("unparseable") * 10 - texts * 3 - dates * 2 - labels * 2
    )
    return measured.withColumn("quality_score", F.greatest(F.lit(0.0), score.cast("double")))


def recommendations(measured: DataFrame, name: str) -> DataFrame:
    """One row per rule that applies."""
    tests = [F.col("quality_score") < 80, F.col("duplicates") > 0, F.col("missing") > 0, F.col("unparseable") > 0]
    rules = zip(tests, RECOMMENDATIONS, strict=True)
    found = F.array_compact(F.array(*[F.when(c, F.lit(m.format(name=name))) for c, m in rules]))
    return measured.select(F.explode(found).alias("recommendation"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values.  Values are compared by two 64-bit hashes."""
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g"), F.col(c).isNull().alias("empty"))
                    for c in df.columns
                ]
            )
        )
    )
    values = long.groupBy("column", "h", "g", "empty").agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("empty"), F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if(~F.col("empty")).alias("distinct_values"),
    )


def top_values(df: DataFrame, columns: list[str], k: int = 5, low: int = 2, high: int = 19) -> DataFrame:
    """The k most frequent values of columns with between ``low`` and ``high`` distinct values."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    ).filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    # the high + 1 most frequent values tell both the first k and whether there are more than ``high``
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    most = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= high + 1)
    width = F.max("place").over(W.partitionBy("column"))
    return most.withColumn("_w", width).filter((F.col("place") <= k) & F.col("_w").between(low, high)).drop("_w")
