"""Trade tape and bars from the ``events`` table.

ticker = event_type, price = value, size = the ``k`` member of props. Bars are hourly and a
trading day is the calendar day, so a (ticker, trading_day) group has at most 24 bars (1,440
at minute resolution): every day-local window below has that bound whatever the tape's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bars as B
from .tables import table

# Fixed values of this adapter.
INTERVAL_MINUTES = 60
HORIZON_K = 2
BAND_BPS = 500.0
SPLITS = B.SplitBoundaries("2024-01-01", "2024-01-21", "2024-01-21", "2024-01-27", "2024-01-31")


def tape(spark: SparkSession, sf_dir: str, end: str | None = None) -> DataFrame:
    """Trades, optionally before ``end`` (the bound reaches the Parquet scan)."""
    events = table(spark, sf_dir, "events")
    if end:
        events = events.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return events.select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def ticks_as_minutes(spark: SparkSession, sf_dir: str, end: str | None = None) -> DataFrame:
    """The tape in raw-bar form (one OHLCV row per trade) for the resampler."""
    t = tape(spark, sf_dir, end)
    return t.select("ticker", "timestamp", F.col("price").alias("open"), F.col("price").alias("high"),
                    F.col("price").alias("low"), F.col("price").alias("close"),
                    F.col("size").alias("volume"), F.col("event_id").alias("tie"))


def bars(spark: SparkSession, sf_dir: str, interval: int = INTERVAL_MINUTES,
         end: str | None = None) -> DataFrame:
    """Hourly bars with trading_day and split. ``end`` must lie on a bar boundary."""
    b = B.resample(ticks_as_minutes(spark, sf_dir, end), interval, tie="tie")
    return B.assign_split(b, SPLITS)
