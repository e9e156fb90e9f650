"""Streaming counts of consecutive labels: windows over event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(stream: DataFrame, time: str = "ts", label: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and label; rows later than the watermark are left out of a stream (a batch keeps all)."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "label", "n")
