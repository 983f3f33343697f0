"""Streams: first rows by key, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """One row of each key; on a stream, keys are remembered for ``delay`` of event time, so state stays bounded."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def counts(rows: DataFrame, ts: str, window: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """``(start, by..., n)``: rows by window of event time; on a stream, rows later than ``delay`` may be left out."""
    d = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return d.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
