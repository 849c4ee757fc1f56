"""Session helpers: builder, shared work folder, spreading of few splits, columns computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Setting: into how many tasks the queries deal the rows of the ``documents`` scan; unset, the scan's splits stay.
SPREAD = "spark.glosa.spread"


def build_session(
    app: str = "glosa", cores: str = "*", shuffle_partitions: int = 8, work: str | None = None, spread: int | None = None
) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own.

    ``work`` is the shared folder for written tables (``spark.checkpoint.dir``).
    """
    own = {"spark.checkpoint.dir": work, SPREAD: spread}
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map={k: str(v) for k, v in own.items() if v})
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for files that several tasks must see, under ``spark.checkpoint.dir``.

    Where that is unset, a local session uses its warehouse; a cluster has no folder that is known to be shared, so
    the job is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if (spark.conf.get("spark.master", None) or "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, text: str) -> DataFrame:
    """Deal the rows into as many tasks as ``spark.glosa.spread`` says; without the setting, as they come.

    It is for tables that are one file with one row group.  ``compute_once`` keeps filters on
    the text above the exchange; without it they would run in the single scan task.
    """
    tasks = df.sparkSession.conf.get(SPREAD, None)
    return compute_once(df.repartition(int(tasks), key), {text: F.col(text)}) if tasks else df


#: Setting: files of an action's shuffles are removed when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(
    df: DataFrame, purpose: str, partition_by: list[str] | None = None, tidy: bool = False, options: dict | None = None
) -> DataFrame:
    """Write to the shared work folder and read back: cuts lineage, survives lost executors.

    With ``tidy`` the shuffle files of the write are removed when it has ended, as nothing reads them again; else they
    stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        writer = df.write.mode("overwrite").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compute_once(df: DataFrame, columns: dict) -> DataFrame:
    """Add columns that later filters must not evaluate again.

    The optimizer moves a filter below a projection by copying the filtered
    expression, so a costly one would run twice or more.  Filters are not moved
    below a one-row ``inline``.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(row)))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Several one-row tables as one row, without a join."""
    merged = rows[0]
    for other in rows[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
