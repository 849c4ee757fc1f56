"""Structured Streaming jobs over landing folders.

Progress is kept in each query's checkpoint, so a restarted job continues after
the last completed batch.  ``availableNow`` drains what has landed and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosa.sources.readers import PAGE, flatten_pages


def _drain(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_pages(spark: SparkSession, landing: str, sink: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Appends the comments of every newly landed API page to a Parquet folder, once."""
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).json(landing)
    _drain(flatten_pages(pages).writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def append_new(stream: DataFrame, key: str, order: str, sink: str, checkpoint: str) -> None:
    """Appends the rows whose key no earlier batch has written, however late they come.

    Of several rows of a key in one batch the first by ``order`` stays.  Only the keys of the sink are
    read back; a repeated batch looks at the batches before it and replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.min_by(F.struct(*batch.columns), F.col(order)).alias("row")
        first = batch.groupBy(key).agg(row).select("row.*")
        if batch_id:
            schema = f"{batch.schema[key].name} {batch.schema[key].dataType.simpleString()}, batch int"
            known = spark.read.schema(schema).parquet(sink).filter(F.col("batch") < batch_id)
            first = first.join(known, key, "left_anti")
        first.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _drain(stream.writeStream.foreachBatch(write), checkpoint)


def score_batches(stream: DataFrame, model, columns: list[str], sink: str, checkpoint: str) -> None:
    """Scores every batch with a fitted model; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        model.transform(batch).select(*columns).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _drain(stream.writeStream.foreachBatch(write), checkpoint)


def daily_counts(events: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Running counts per day; the state has one row per day and key."""
    day = F.window(ts, "1 day").alias("w")  # days of the written time, whatever the session's zone
    return events.groupBy(day, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def keep_latest(counts: DataFrame, sink: str, checkpoint: str) -> None:
    """Writes the complete result after every batch to its own folder; the highest batch is current."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _drain(counts.writeStream.outputMode("complete").foreachBatch(write), checkpoint)
