"""Event-time windows; the same code runs on tables and on streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_limit(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    return df.withWatermark(time, delay) if delay and df.isStreaming else df


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Windows need zoned timestamps; times without a zone are taken as the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], delay: str | None = None) -> DataFrame:
    rows = late_limit(event_time(df, time), time, delay)
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], delay: str | None = None) -> DataFrame:
    rows = late_limit(event_time(df, time), time, delay)
    return rows.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    rows = late_limit(event_time(df, time), time, delay)
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
