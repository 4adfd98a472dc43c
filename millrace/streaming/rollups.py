"""Windowed rollups that run the same over a batch and over a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A watermark needs a timestamp with the session's zone; sources may have one without."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def buckets(events: DataFrame, length: str = "1 day", late: str | None = "1 day", offset: str | None = None) -> DataFrame:
    """start, event_type, n, value_sum of tumbling windows. late: watermark; a day is final once it has passed.
    A week from Monday is length `7 days` with offset `4 days`, as the epoch was a Thursday."""
    timed = event_time(events, "ts")
    if late and timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.window("ts", length, length, offset) if offset else F.window("ts", length)
    out = timed.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value_sum"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value_sum")


def rate(events: DataFrame, by: str, amount: str, seconds: int = 60) -> DataFrame:
    """events with `used`: what the key used in the seconds up to and with each event."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("used", F.sum(amount).over(w))


def daily_usage(events: DataFrame, by: str, amount: str) -> DataFrame:
    return events.groupBy(by, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.sum(amount).alias("used"))
