"""Tumbling, sliding and session windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    # a watermark needs a timestamp with zone; for batches it has no effect
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, watermark) if watermark and df.isStreaming else df


def windowed(df: DataFrame, time: str, length: str, keys: list[str], aggregates: list[Column], slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Aggregates per tumbling window, or sliding one with ``slide``; adds ``start`` and ``end``."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = _late(df, time, watermark).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], watermark: str | None = None) -> DataFrame:
    """Aggregates per session: rows of a key less than ``gap`` apart."""
    out = _late(df, time, watermark).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def first_by_key(df: DataFrame, time: str, keys: list[str], watermark: str) -> DataFrame:
    """Each key's first row within the watermark."""
    df = _late(df, time, watermark)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
