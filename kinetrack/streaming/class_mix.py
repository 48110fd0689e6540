"""Structured Streaming form of the per-window class mix: state changes arrive as events, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_mix_stream(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts of each event type per tumbling window; a window is final once the watermark has passed it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")
