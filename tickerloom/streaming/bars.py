"""Streaming bars: open, high, low, close of values in event-time windows, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_bars(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars (ticker, start, open, high, low, close, n) of events (ticker, ts, value, event_id).

    Works on a batch or a stream; on a stream, rows later than ``late`` are dropped by the watermark
    and a window is final once that has passed its end. Ties in time go by event_id. A time without
    a zone is read in the session's zone, on both paths.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs this type
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    bars = events.groupBy(F.window("ts", every).alias("w"), "ticker").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n")
    )
    return bars.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
