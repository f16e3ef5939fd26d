"""Day-local technical features: built-in window functions over (ticker, trading_day)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import ratio, safe_log

FEATURES = ["log_return", "close_to_open_return", "high_low_range", "rolling_volatility_20", "rsi_14",
            "bollinger_pctb", "normalized_macd_hist", "normalized_volume_20", "time_of_day_sin",
            "time_of_day_cos"]

def day():
    return Window.partitionBy("ticker", "trading_day").orderBy("timestamp")


def trailing(n: int):
    return day().rowsBetween(-(n - 1), 0)


def gated(value: Column, counted: Column, n: int, minimum: int) -> Column:
    """A trailing statistic that exists once ``minimum`` non-null values are in its frame."""
    return F.when(F.count(counted).over(trailing(n)) >= minimum, value)


def ewm(x: Column, alpha: float, i: Column, frame) -> Column:
    """Recursive exponential mean seeded with the first value, as one running sum.

    y_t = sum_i w_i (1-a)^(t-i) x_i with w_0 = 1 and w_i = a. Dividing by (1-a)^t turns the
    recursion into a prefix sum; a day has at most 1,440 bars, so the scale stays in range.
    """
    keep = 1.0 - alpha
    weight = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    return F.sum(weight * x * F.pow(F.lit(1.0 / keep), i)).over(frame) * F.pow(F.lit(keep), i)


def add_features(bars: DataFrame, open_minute: int = 570, session_minutes: int = 390) -> DataFrame:
    """All ten features. Intermediate columns are staged so each window runs once."""
    close = F.col("close")
    run = day().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumns({
        "_prev": F.lag("close").over(day()), "_i": (F.row_number().over(day()) - 1).cast("double"),
    })
    phase = 2 * math.pi * (F.hour("timestamp") * 60 + F.minute("timestamp") - open_minute) / session_minutes
    d = close - F.col("_prev")
    b = b.withColumns({
        "log_return": safe_log(ratio(close, F.col("_prev"))),
        "close_to_open_return": safe_log(ratio(close, F.col("open"))),
        "high_low_range": ratio(F.col("high") - F.col("low"), close),
        "_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
        "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        "_e12": ewm(close, 2.0 / 13, F.col("_i"), run), "_e26": ewm(close, 2.0 / 27, F.col("_i"), run),
        "time_of_day_sin": F.sin(phase), "time_of_day_cos": F.cos(phase),
    }).withColumn("_macd", F.col("_e12") - F.col("_e26"))
    b = b.withColumns({
        "_sig": ewm(F.col("_macd"), 0.2, F.col("_i"), run),
        "rolling_volatility_20": gated(F.stddev_samp("log_return").over(trailing(20)),
                                       F.col("log_return"), 20, 5),
        "_ag": gated(F.avg("_gain").over(trailing(14)), F.col("_gain"), 14, 5),
        "_al": gated(F.avg("_loss").over(trailing(14)), F.col("_loss"), 14, 5),
        "_m": gated(F.avg("close").over(trailing(20)), close, 20, 10),
        "_s": gated(F.stddev_samp("close").over(trailing(20)), close, 20, 10),
        "_mv": gated(F.avg("volume").over(trailing(20)), F.col("volume"), 20, 5),
    })
    rs = ratio(F.col("_ag"), F.col("_al"))
    return b.withColumns({
        "rsi_14": F.when((F.col("_al") == 0) & (F.col("_ag") > 0), F.lit(1.0))
                   .otherwise(1.0 - F.try_divide(F.lit(1.0), 1.0 + rs)),
        "bollinger_pctb": ratio(close - (F.col("_m") - 2 * F.col("_s")), 4 * F.col("_s")),
        "normalized_macd_hist": ratio(F.col("_macd") - F.col("_sig"), F.col("_s")),
        "normalized_volume_20": ratio(F.col("volume"), F.col("_mv")) - 1.0,
    }).drop("_prev", "_i", "_gain", "_loss", "_e12", "_e26", "_macd", "_sig", "_ag", "_al", "_m", "_s", "_mv")
