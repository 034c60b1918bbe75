"""Trends and crisis rates over streams, an extension: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """A watermark on the event time; a timestamp without zone is read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed_counts(df: DataFrame, key: str, column: str = "ts", width: str = "7 days") -> DataFrame:
    """Rows by window and key."""
    return df.groupBy(F.window(column, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def windowed_rate(df: DataFrame, hits: str, words: str, column: str = "ts", width: str = "7 days") -> DataFrame:
    """Hits per 1000 words by window."""
    s = df.groupBy(F.window(column, width)).agg(F.sum(hits).alias("hits"), F.sum(words).alias("words"))
    return s.select(F.col("window.start").alias("start"), "hits", "words", F.round(1000 * F.col("hits") / F.nullif(F.col("words"), F.lit(0)), 2).alias("rate"))


def sessions(df: DataFrame, key: str, column: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Runs of activity of each key."""
    s = df.groupBy(F.session_window(column, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_per_id(df: DataFrame, key: str) -> DataFrame:
    """Each id once within the watermark."""
    return df.dropDuplicatesWithinWatermark([key])
