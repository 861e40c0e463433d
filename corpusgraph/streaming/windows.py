"""Windowed counts over event streams, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n, total by tumbling windows; the same on streams and tables. State is dropped once the watermark passes a window."""
    kept = events.withWatermark(time, late)
    return kept.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def replay(events: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now, appending windows to Parquet; it resumes from the checkpoint, each row once."""
    stream = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
