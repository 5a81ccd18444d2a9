"""Streaming bars: the batch operator under a watermark, written by available-now triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barquarry.sources.bars import event_bars


def stream_event_bars(spark: SparkSession, folder: str, glob: str, width: str = "1 hour") -> DataFrame:
    """Closed bars of event files, appended as the watermark passes; late events are dropped by it."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return event_bars(events, width)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is available now to a Parquet table, exactly once for each checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
