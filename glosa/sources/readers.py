"""Readers: CSV with optional columns, tab-separated, headerless, API pages, JSON dumps."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from glosa.operators.filters import validated

# Quotes inside quoted cells are doubled, as every CSV writer of the trade does.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
REQUIRED = ["original_comment", "published_at"]
OPTIONAL = ["comment_id", "detected_language", "like_count"]
LABELS = {"spam_label": ["spam_label", "is_spam"], "emotion_label": ["emotion_label"]}

_SNIPPET = Ty.StructType(
    [
        Ty.StructField("textDisplay", Ty.StringType()),
        Ty.StructField("publishedAt", Ty.StringType()),
        Ty.StructField("authorDisplayName", Ty.StringType()),
        Ty.StructField("likeCount", Ty.LongType()),
    ]
)
_TOP = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("snippet", _SNIPPET)])
_ITEM = Ty.StructType(
    [
        Ty.StructField(
            "snippet",
            Ty.StructType(
                [Ty.StructField("topLevelComment", _TOP), Ty.StructField("totalReplyCount", Ty.LongType())]
            ),
        )
    ]
)
PAGE = Ty.StructType(
    [Ty.StructField("items", Ty.ArrayType(_ITEM)), Ty.StructField("nextPageToken", Ty.StringType())]
)


def filled(column: Column) -> Column:
    """Null for empty cells."""
    return F.when(column != "", column)


def read_csv(spark: SparkSession, path, multi_line: bool = True, schema=None, **options) -> DataFrame:
    """All columns as strings.  ``multi_line=False`` lets one large file be split over tasks;
    use it for files whose cells hold no line breaks, such as those of ``write_quoted_csv``.
    With ``schema`` (the column names in their order) no header is looked up."""
    reader = spark.read.options(**{**CSV, "multiLine": multi_line, **options})
    if schema:
        reader = reader.schema(Ty.StructType([Ty.StructField(n, Ty.StringType()) for n in schema]))
    return reader.csv(path)


def read_comments(spark: SparkSession, path, multi_line: bool = True, language: str | None = None) -> DataFrame:
    """Required columns, the optional ones that exist, labels with a default; rows without text or date dropped."""
    raw = read_csv(spark, path, multi_line)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    if language and "detected_language" in raw.columns:
        raw = raw.filter(F.col("detected_language") == language)
    columns = [filled(F.col(c)).alias(c) for c in REQUIRED]
    columns += [filled(F.col(c)).alias(c) for c in OPTIONAL if c in raw.columns]
    for label, names in LABELS.items():
        present = [filled(F.col(n)) for n in names if n in raw.columns][:1]
        columns.append(F.coalesce(*present, F.lit("unknown")).alias(label))
    return raw.select(*columns).na.drop(subset=REQUIRED)


def read_validated(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return validated(read_comments(spark, path, multi_line))


def read_headerless(spark: SparkSession, path, index: int, name: str = "text", multi_line: bool = True) -> DataFrame:
    """One column of a file without header, by position; missing cells become empty strings."""
    raw = read_csv(spark, path, multi_line, header=False)
    return raw.select(F.coalesce(f"_c{index}", F.lit("")).alias(name))


def read_tsv(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, multi_line, sep="\t")


def headers(spark: SparkSession, paths) -> dict[str, tuple[str, ...]]:
    """Column names of every CSV file under ``paths``: the first line of each, found in one job for all files."""
    lines = spark.read.text(paths, recursiveFileLookup=True, pathGlobFilter="*.csv").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("i"),  # rises with the lines of a split
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "i").alias("line"))
    return {unquote(r.file): tuple(next(csv.reader([r.line]))) for r in first.collect()}


def read_spam_training(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spam rows of all files that have CONTENT and CLASS columns; other files are left out.

    One job finds all headers; files with the same header share a scan.
    """
    frames: dict[tuple, list[str]] = {}
    for file, names in headers(spark, paths).items():
        if {"CONTENT", "CLASS"} <= set(names):
            frames.setdefault(names, []).append(file)
    if not frames:
        raise ValueError("no training file has CONTENT and CLASS columns")
    rows = None
    for names, group in frames.items():
        part = read_csv(spark, group, schema=names).filter(F.col("CLASS") == "1")
        part = part.select(F.col("CONTENT").alias("text"), F.lit(1).alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row per comment of an API page; a row needs a text and a date."""
    items = pages.select(F.explode("items").alias("item")).select("item.snippet.topLevelComment.*")
    return items.filter("snippet.textDisplay <> '' AND snippet.publishedAt <> ''").select(
        F.col("id").alias("comment_id"),
        F.col("snippet.textDisplay").alias("original_comment"),
        F.col("snippet.authorDisplayName").alias("author_name"),
        F.col("snippet.publishedAt").alias("published_at"),
        F.timestamp_diff(
            "SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"),
            F.col("snippet.publishedAt").try_cast("timestamp_ntz"),
        ).alias("published_at_unix"),
        F.col("snippet.likeCount").alias("like_count"),
    )


def read_pages(spark: SparkSession, path) -> DataFrame:
    return flatten_pages(spark.read.schema(PAGE).json(path))


def read_dump(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Rows of ``{"comments": [...]}`` records with the union of all keys that occur.

    A file is one record; with ``multi_line=False`` every line is one, and a file can be split over tasks.
    """
    dump = spark.read.option("multiLine", multi_line).json(path)
    return dump.select(F.explode("comments").alias("c")).select("c.*")


def text_column(df: DataFrame, least_mean: float = 10.0) -> str:
    """``text``, else ``comment``, else the first string column whose mean length exceeds ``least_mean``."""
    for name in ("text", "comment"):
        if name in df.columns:
            return name
    strings = [f.name for f in df.schema if isinstance(f.dataType, Ty.StringType)]
    means = df.agg(*[F.avg(F.length(c)).alias(c) for c in strings]).first()
    for name in strings:
        if means[name] is not None and means[name] > least_mean:
            return name
    raise ValueError("no text column")
