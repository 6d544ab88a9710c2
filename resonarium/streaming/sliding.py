"""Streaming extension: sliding correlation of two channels from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.operators.packed import correlation


def sliding_correlation(events: DataFrame, x: str, y: str, bucket: str = "1 hour", window: str = "1 day", slide: str = "12 hours", watermark: str = "1 hour") -> tuple[DataFrame, str]:
    """Rows (start, n, correlation) of two channels' bucket sums over sliding spans, null where one is constant. events: (ts, channel, value).

    Both aggregations share one watermark, so a stream emits a span once it can
    no longer change (append mode); a batch frame gives the same rows. Returns
    the frame and the output mode it needs.
    """
    rows = events.where(F.col("channel").isin(x, y)).withWatermark("ts", watermark)
    buckets = rows.groupBy(F.window("ts", bucket).alias("bucket")).agg(
        F.sum(F.when(F.col("channel") == x, F.col("value")).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("channel") == y, F.col("value")).otherwise(0.0)).alias("y")
    )
    spans = buckets.groupBy(F.window(F.window_time("bucket"), window, slide).alias("span")).agg(F.count("*").alias("n"), correlation("x", "y").alias("correlation"))
    return spans.select(F.col("span.start").alias("start"), "n", "correlation"), "append"
