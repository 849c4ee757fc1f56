"""Writers: quoted CSV, one folder per year, insight rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from glosa.functions.text import one_line


def write_quoted_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every cell quoted, quotes doubled, line breaks in strings turned into spaces.

    Without line breaks the files can be split when they are read again.
    """
    strings = {f.name: one_line(F.col(f.name)) for f in df.schema if isinstance(f.dataType, Ty.StringType)}
    df.withColumns(strings).write.mode(mode).options(
        header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """Cells as they are, line breaks included; read with ``multi_line=True``."""
    base = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df.write.mode(mode).options(**{**base, **options}).csv(path)


def write_by_year(df: DataFrame, path: str, ts: str = "published_at", mode: str = "errorifexists") -> None:
    """One folder per year; rows without a valid date are dropped.

    No shuffle by year: a year may hold a third of all rows, so every task writes
    its own file per year instead of one task writing a whole year.
    """
    df.withColumn("year", F.year(ts)).filter("year IS NOT NULL").write.mode(mode).partitionBy("year").parquet(path)


def insight_rows(insights: DataFrame, metric: str, key: str | None = None) -> DataFrame:
    """Tidy (metric, key, value) rows of a summary table."""
    values = [c for c in insights.columns if c != key]
    cells = F.array(
        *[
            F.struct(F.lit(f"{metric}.{c}").alias("metric"),
                     (F.col(key).cast("string") if key else F.lit("")).alias("key"),
                     F.col(c).cast("string").alias("value"))
            for c in values
        ]
    )
    return insights.select(F.inline(cells))


def write_insights(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)
