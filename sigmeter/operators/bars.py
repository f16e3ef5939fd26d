"""Session filter, resampling, split tags and calendar buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SplitBoundaries:
    """Half-open split bounds as ISO text."""

    train_start: str
    train_end: str
    validation_start: str
    validation_end: str
    data_end: str


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_filter(df: DataFrame, open_minute: int, close_minute: int, include_close: bool,
                   ts: str = "timestamp") -> DataFrame:
    """Rows inside the session; the right end is open unless ``include_close``.

    With the close included only its exact minute start counts, as a time-of-day test.
    """
    secs = minute_of_day(ts) * 60 + F.second(ts)
    upper = (secs <= close_minute * 60) if include_close else (secs < close_minute * 60)
    return df.filter((secs >= open_minute * 60) & upper)


def trading_day(ts: Column | str = "timestamp") -> Column:
    return F.to_date(ts).cast("string")


def bar_start(ts: Column | str, minutes: int) -> Column:
    """Left label of the tumbling bucket, counted from midnight."""
    c = F.col(ts) if isinstance(ts, str) else ts
    bucket = F.floor(minute_of_day(c) / F.lit(minutes)).cast("int") * minutes
    return F.date_trunc("day", c).cast("timestamp_ntz") + F.make_dt_interval(mins=bucket)


def resample(df: DataFrame, minutes: int, session: tuple[int, int] | None = None,
             tie: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars per (ticker, day): left-closed, left-labelled.

    The session keeps the closing minute on input and drops the bar that starts at the close.
    Partial aggregates collapse the ticks before the shuffle, so a hot ticker sends at most one
    row per bar and task. Equal timestamps are ordered by ``tie`` (or by the whole row).
    """
    if session:
        df = session_filter(df, session[0], session[1], include_close=True)
    rest = [tie] if tie else ["open", "high", "low", "close", "volume"]

    # First and last skip blanks: a null price carries no order key.
    def first_last(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct("timestamp", *rest))

    out = df.groupBy("ticker", trading_day().alias("trading_day"),
                     bar_start("timestamp", minutes).alias("bar")).agg(
        F.min_by("open", first_last("open")).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", first_last("close")).alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "timestamp")
    if session:
        out = session_filter(out, session[0], session[1], include_close=False)
    out = out.dropna(subset=["open", "high", "low", "close", "volume"])
    return out.select("ticker", "trading_day", "timestamp", "open", "high", "low", "close", "volume")


def split_of(ts: Column | str, b: SplitBoundaries) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts

    def at(text: str) -> Column:
        return F.lit(text).cast("timestamp_ntz")

    return (F.when((c >= at(b.train_start)) & (c < at(b.train_end)), "train")
            .when((c >= at(b.validation_start)) & (c < at(b.validation_end)), "validation")
            .when((c >= at(b.validation_end)) & (c < at(b.data_end)), "closed_holdout_test")
            .otherwise("outside"))


def assign_split(df: DataFrame, b: SplitBoundaries, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("split", split_of(ts, b))


def keep_open_splits(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "validation"))


def calendar_columns(df: DataFrame, ts: str = "target_timestamp") -> DataFrame:
    return df.withColumns({
        "calendar_year": F.year(ts).cast("string"),
        "calendar_quarter": F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)),
        "calendar_month": F.date_format(ts, "yyyy-MM"),
        "time_of_day_hour": F.lpad(F.hour(ts).cast("string"), 2, "0"),
    })


def yearly_periods(df: DataFrame, start: str, ts: str = "timestamp", prefix: str = "wf_") -> DataFrame:
    """Consecutive one-year periods from ``start`` to the last row; the last one is cut there."""
    last = df.agg((F.max(ts) + F.expr("INTERVAL '1' MICROSECOND")).alias("stop"))
    begin = F.lit(start).cast("timestamp_ntz")
    years = last.filter(F.col("stop") > begin).select(
        "stop", F.explode(F.sequence(begin, F.col("stop") - F.expr("INTERVAL '1' MICROSECOND"),
                                     F.expr("INTERVAL '1' YEAR"))).alias("period_start"))
    return years.select(
        F.concat(F.lit(prefix), F.year("period_start")).alias("period_id"), "period_start",
        F.least(F.col("period_start") + F.expr("INTERVAL '1' YEAR"), "stop").alias("period_end"),
    )
