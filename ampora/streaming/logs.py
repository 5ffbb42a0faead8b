"""Streaming forms of the pipeline's log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """At most one row per key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped by the engine's own rule."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and ends; a rerun continues after the last batch."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
