"""Tumbling bars over a tick stream: the batch resampler's aggregate under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.bars import bar_start, trading_day


def stream_bars(ticks: DataFrame, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """OHLCV bars per (ticker, bar) of (ticker, timestamp, price, size, tie) ticks.

    Event time moves to a zoned column for the watermark; the bar label stays naive, so the
    result equals the batch bars. State holds one row per open (ticker, bar).
    """
    key = F.struct("timestamp", "tie")
    zoned = ticks.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    return zoned.groupBy("ticker", F.window("event_time", f"{minutes} minutes"), trading_day().alias("trading_day"),
                         bar_start("timestamp", minutes).alias("bar")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.sum("size").alias("volume"),
    ).select("ticker", "trading_day", F.col("bar").alias("timestamp"), "open", "high", "low", "close", "volume")
