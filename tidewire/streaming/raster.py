"""Structured Streaming: event streams binned into series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour", slide: str | None = None, time_col: str = "ts", process_col: str = "event_type", value_col: str = "value") -> DataFrame:
    """process, begin, value, n per window; rows later than ``lateness`` are dropped by the watermark.

    Works on streams and on batches alike.
    """
    own = events.select(F.col(time_col).cast("timestamp").alias("ts"), F.col(process_col).alias("process"), F.col(value_col).alias("value"))
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return own.withWatermark("ts", lateness).groupBy(window.alias("w"), "process").agg(F.sum("value").alias("value"), F.count("*").alias("n")).select("process", F.col("w.start").alias("begin"), "value", "n")
