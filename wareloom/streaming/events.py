"""Streaming forms: an event log, windowed counts with late data, first-wins de-duplication.

An extension for pipelines that keep running; the batch operators do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "total")
    )


def first_arrivals(events: DataFrame, key: str = "event_id", late: str = "30 minutes") -> DataFrame:
    """One row a key among the rows inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later run goes on where this one ended."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
