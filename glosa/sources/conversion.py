"""CSV to Parquet conversion, type coercion and the check of a conversion."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from glosa.session import side_by_side
from glosa.sources.readers import headers, read_csv

# ---------------------------------------------------------------- fixed values
CODECS = ["snappy", "gzip", "brotli", "zstd", "none"]
NUMERIC = ["like_count", "dislike_count", "reply_count", "view_count", "subscriber_count"]
TIMES = ["published_at_unix", "timestamp", "unix_timestamp", "created_at_unix"]
TRUE, FALSE = ["true", "yes", "1", "t", "y"], ["false", "no", "0", "f", "n"]
FLAG_STARTS, FLAG_ENDS = ("is_", "has_"), ("_flag", "_enabled")
TIME_PARTS, COUNT_END = ("_unix", "timestamp", "epoch"), "count"
# ------------------------------------------------------------ end fixed values


def kind_of(name: str) -> str:
    """boolean, time, number or other, by column name.  Ids stay what they are."""
    low = name.lower()
    if low.startswith(FLAG_STARTS) or low.endswith(FLAG_ENDS):
        return "boolean"
    if low in TIMES or any(s in low for s in TIME_PARTS):
        return "time"
    if low in NUMERIC or low.endswith(COUNT_END):
        return "number"
    return "other"


def coerce_types(df: DataFrame) -> DataFrame:
    """String columns become booleans or numbers by name; unknown booleans are null, bad numbers 0."""
    columns = {}
    for field in df.schema:
        if not isinstance(field.dataType, Ty.StringType):
            continue
        cell, kind = F.col(field.name), kind_of(field.name)
        if kind == "boolean":
            low = F.lower(cell)
            columns[field.name] = F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)
        elif kind == "time":
            columns[field.name] = F.coalesce(cell.try_cast("double"), F.lit(0.0))
        elif kind == "number":
            columns[field.name] = F.coalesce(
                cell.try_cast("long"), cell.try_cast("double").try_cast("long"), F.lit(0)
            )
    return df.withColumns(columns) if columns else df


def _relative(file: str, root: str) -> str:
    root = root.rstrip("/") + "/"
    return os.path.splitext(file[file.index(root) + len(root):])[0]


def convert_tree(
    spark: SparkSession, source: str, target: str, compression: str = "snappy", overwrite: bool = False,
    multi_line: bool = True, at_once: int = 16,
) -> list[str]:
    """Converts every CSV file below ``source`` to Parquet at the same relative path below ``target``.

    Existing targets are skipped unless ``overwrite``.  One job finds all headers; then each file is one
    distributed job without a look at its header, ``at_once`` of them side by side.
    """
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression}")
    mode = "overwrite" if overwrite else "ignore"

    def convert(item) -> str:
        file, names = item
        out = f"{target.rstrip('/')}/{_relative(file, source)}.parquet"
        rows = coerce_types(read_csv(spark, file, multi_line, schema=names))
        rows.write.mode(mode).option("compression", compression).parquet(out)
        return out

    with ThreadPoolExecutor(at_once) as pool:
        return sorted(pool.map(inheritable_thread_target(spark)(convert), headers(spark, source).items()))


def compare_tables(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Per column: rows that have a partner and cells that differ.

    Rows are first merged per key, so the join meets each key once, however often a table repeats it.  A key
    that both sides have once is compared cell by cell, numbers within ``tolerance`` and other cells by digest.
    A repeated key is compared as a multiset of cells, numbers rounded to ``tolerance``: as many rows as the
    smaller side has count as compared, and every cell of the larger side without an equal one as differing.
    Rows on one side only differ in every column.
    """
    names = [c for c in left.columns if c != key and c in right.columns]
    numeric = {f.name for f in left.schema if isinstance(f.dataType, Ty.NumericType)} & {
        f.name for f in right.schema if isinstance(f.dataType, Ty.NumericType)
    }

    def cells(df: DataFrame) -> DataFrame:
        own = [
            F.col(c).cast("double").alias(c) if c in numeric else F.xxhash64(F.lit(c), F.col(c).cast("string")).alias(c)
            for c in names
        ]
        return df.select(F.col(key).alias("_key"), *own)

    def merged(df: DataFrame, count: str, side: str) -> DataFrame:
        first = F.struct(*[F.max(c).alias(c) for c in names]).alias(side)
        return df.groupBy("_key").agg(F.count("*").alias(count), first).withColumnRenamed("_key", f"_key_{side}")

    a, b = cells(left), cells(right)
    joined = merged(a, "_na", "a").join(merged(b, "_nb", "b"), F.col("_key_a").eqNullSafe(F.col("_key_b")), "full")
    joined = joined.fillna(0, ["_na", "_nb"])
    single = (F.col("_na") <= 1) & (F.col("_nb") <= 1)

    def same(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        equal = F.coalesce(F.abs(x - y) < tolerance, x.isNull() & y.isNull()) if c in numeric else x.eqNullSafe(y)
        return equal & F.col("a").isNotNull() & F.col("b").isNotNull()

    both = F.least("_na", "_nb")
    counted = joined.agg(F.sum(both).alias("compared"), *[F.count_if(single & ~same(c)).alias(c) for c in names])
    direct = counted.unpivot(["compared"], names, "column", "differing")

    repeated = joined.filter(~single).select(F.coalesce("_key_a", "_key_b").alias("_again"))

    def long(df: DataFrame, mine: str, other: str) -> DataFrame:
        rows = df.join(repeated, F.col("_key").eqNullSafe(F.col("_again")), "left_semi")
        cell = [
            F.struct(F.lit(c).alias("column"), (F.round(F.col(c) / tolerance) if c in numeric else F.col(c)).cast("string").alias("v"))
            for c in names
        ]
        return rows.select("_key", F.inline(F.array(*cell))).withColumns({mine: F.lit(1), other: F.lit(0)})

    each = long(a, "x", "y").unionByName(long(b, "y", "x")).groupBy("column", "_key", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    per_key = each.groupBy("column", "_key").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.least("x", "y")).alias("equal")
    )
    more = per_key.groupBy("column").agg(F.sum(F.greatest("x", "y") - F.col("equal")).alias("more"))
    return direct.join(F.broadcast(more), "column", "left").select(  # one row per column
        "column", F.coalesce("compared", F.lit(0)).alias("compared"),
        (F.col("differing") + F.coalesce("more", F.lit(0))).alias("differing"),
    )


def compare_types(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per column of either table: both types and whether they are equal; a missing column has no type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    rows = [(c, a.get(c), b.get(c), a.get(c) == b.get(c)) for c in dict.fromkeys([*a, *b])]
    return left.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string, equal boolean")


def tree_status(spark: SparkSession, source: str, target: str, multi_line: bool = True) -> DataFrame:
    """One row per CSV file below ``source``: rows and columns of both sides, rows lost, status.

    Files with the same header are counted in one scan, all converted files in another; the footers of the
    converted files give their columns.  A file without a conversion is 'missing'.
    """
    groups: dict[tuple, list[str]] = {}
    for file, names in headers(spark, source).items():
        groups.setdefault(names, []).append(file)
    source_rows: dict[str, int] = {}
    for names, files in groups.items():
        rows = read_csv(spark, files, multi_line, schema=names).groupBy(F.col("_metadata.file_path").alias("f")).count()
        source_rows |= {unquote(r.f): r["count"] for r in rows.collect()}  # one row per file
    found = spark.read.schema("_none int").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    counts = found.parquet(target).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    converted: dict[str, int] = {}
    for r in counts:
        folder = _relative(os.path.dirname(unquote(r.f)), target)
        converted[folder] = converted.get(folder, 0) + r["count"]

    def row(item) -> tuple:
        file, names = item
        name = _relative(file, source)
        n, m = source_rows.get(file, 0), converted.get(name)
        if m is None:
            return name, n, None, len(names), None, None, "missing"
        columns = spark.read.parquet(f"{target.rstrip('/')}/{name}.parquet").columns
        lost = round((n - m) * 100.0 / n, 6) if n else None
        ok = set(columns) == set(names) and lost is not None and 0 <= lost < 5
        return name, n, m, len(names), len(columns), lost, "ok" if ok else "failed"

    with ThreadPoolExecutor(16) as pool:
        items = [(file, names) for names, files in groups.items() for file in files]
        rows = sorted(pool.map(inheritable_thread_target(spark)(row), items))
    schema = "file string, source_rows long, converted_rows long, source_columns int, converted_columns int, lost_pct double, status string"
    return spark.createDataFrame(rows, schema)


def conversion_status(source: DataFrame, converted: DataFrame) -> DataFrame:
    """Row and column counts of both sides and the verdict: equal, or fewer rows by under 5 %; more rows fail."""
    rows = source.agg(F.count("*").alias("source_rows"))
    joined = side_by_side(rows, converted.agg(F.count("*").alias("converted_rows")))
    only = sorted(set(source.columns) ^ set(converted.columns))
    lost = F.try_divide((F.col("source_rows") - F.col("converted_rows")) * 100.0, F.col("source_rows"))
    columns_equal = len(source.columns) == len(converted.columns)
    ok = F.lit(columns_equal) & (F.col("source_rows") > 0) & (lost >= 0) & (lost < 5)
    return joined.select(
        "*", F.round(lost, 6).alias("lost_pct"), F.lit(columns_equal).alias("columns_equal"),
        F.lit(",".join(only)).alias("unmatched_columns"),
        F.when(ok, "ok").otherwise("failed").alias("status"),
    )
