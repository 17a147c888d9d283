"""Merging of intervals as they arrive: a store of days that every batch updates, and sessions that close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import micros_between
from ..sources.daytables import DayTables
from ..sources.files import store


def file_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file, in the schema of what is there."""
    reader, (fs, at) = spark.readStream.schema(spark.read.parquet(path).schema), store(spark, path)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if fs.getFileStatus(at).isFile():  # a stream's source is a folder
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def follow(alerts: DataFrame, tables: DayTables, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each batch of a stream of alerts to the tables, under its number. A batch that failed is replayed after a restart from the
    checkpoint, and overwrites what it had written. Late records touch old days and are never lost; no state is kept. trigger:
    as in DataStreamWriter.trigger(); what is there now, and then the end, if nothing is said."""

    def add(batch: DataFrame, number: int) -> None:
        tables.add(batch, number)

    return alerts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def closed_intervals(records: DataFrame, delay: str) -> DataFrame:
    """region, s, e, n_records of a stream of records (region, s, e, UTC or local without a zone): merged intervals, each told once, when the
    watermark (the latest start less `delay`) has passed its end. Overlapping and touching records are one session. A record whose
    end lies behind the watermark when it arrives is left out; the state holds open intervals alone. Append mode."""
    seconds = micros_between(F.col("s"), F.col("e")) / 1e6
    gap = F.make_interval(secs=seconds.cast("decimal(18,6)"))
    rows = records.filter("e > s").withColumn("at", F.col("s").cast("timestamp")).withWatermark("at", delay)
    sessions = rows.groupBy("region", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n_records"))
    return sessions.select("region", F.col("session_window.start").cast("timestamp_ntz").alias("s"), F.col("session_window.end").cast("timestamp_ntz").alias("e"), "n_records")
