"""Model windows: the last w bars of each event as one vector, never crossing a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def window_dataset(features: DataFrame, events: DataFrame, names: list[str], width: int,
                   feature_set: str) -> DataFrame:
    """Events whose last ``width`` bars have only finite cells, with the time-major vector.

    The frame holds ``width`` rows of a day-local window, so the collected array is bounded.
    The bars arrive partitioned by (ticker, trading_day) and the join reuses that shuffle.
    """
    order = Window.partitionBy("ticker", "trading_day").orderBy("timestamp")
    frame = order.rowsBetween(-(width - 1), 0)
    ok = F.lit(True)
    for n in names:
        ok = ok & finite(n)
    w = features.select(
        "ticker", "trading_day", F.col("timestamp").alias("target_timestamp"),
        F.row_number().over(order).alias("_end"),
        F.sum(ok.cast("int")).over(frame).alias("_ok"),
        F.flatten(F.collect_list(F.array(*[F.col(n).cast("float") for n in names])).over(frame)).alias("features"),
    ).filter(F.col("_ok") == width)
    keys = ["ticker", "trading_day", "target_timestamp"]
    ev = events.select("sample_id", *keys, "label", "split")
    return ev.join(w, keys).select(
        "sample_id", *keys, "label", "split",
        (F.col("_end") - width).alias("window_start_position"),
        F.col("_end").alias("window_end_position_exclusive"),
        F.concat(F.lit(feature_set), F.lit(f"_w{width}")).alias("candidate_id"), "features")


def last_bar(features: Column, n_features: int) -> Column:
    return F.slice(features, -n_features, n_features)


def moving_average(features: Column, n_features: int, width: int, kernel: int) -> Column:
    """Centred moving average per feature with replicated edges, on the time-major vector."""
    left = (kernel - 1) // 2

    def cell(i: Column) -> Column:
        t, f = F.floor(i / n_features).cast("int"), (i % n_features).cast("int")
        total = F.lit(0.0)
        for off in range(-left, kernel - left):
            at = F.least(F.greatest(t + off, F.lit(0)), F.lit(width - 1))
            total = total + F.get(features, at * n_features + f)
        return total / kernel

    return F.transform(F.sequence(F.lit(0), F.lit(width * n_features - 1)), cell)
