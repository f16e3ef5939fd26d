"""Bars, labels, features and folds on hand-made sessions."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmeter import schema
from sigmeter.operators import bars as B, features as FT, folds as FD, guards as G, labels as L, windows as WN
from sigmeter.sources.minute_files import read_minute_files

SPLITS = B.SplitBoundaries("2022-01-01", "2022-06-01", "2022-06-01", "2022-09-01", "2022-12-01")


def make_bars(spark, closes, start="2022-03-01 09:30", step=5, ticker="A", stamps=None):
    stamps = stamps or [pd.Timestamp(start) + pd.Timedelta(minutes=step * i) for i in range(len(closes))]
    rows = [(ticker, t.to_pydatetime(), c, c, c, c, 100.0) for t, c in zip(stamps, closes)]
    df = spark.createDataFrame(rows, schema.BARS)
    return B.assign_split(df.withColumn("trading_day", B.trading_day()), SPLITS)


def labelled(spark, closes, k=1, bps=10.0, **kw):
    out = L.direction_labels(make_bars(spark, closes, **kw), L.LabelPolicy(k, bps, 5), SPLITS)
    return out.orderBy("ticker", "timestamp").collect()


def test_up_flat_down(spark):
    rows = labelled(spark, [100.0, 100.2, 100.2, 99.9])
    assert [r["label"] for r in rows] == [1, None, 0, None]
    assert rows[1]["invalid_no_trade_band"] and rows[3]["invalid_missing_future"]
    assert rows[0]["sample_id"] == "A|2022-03-01T09:30:00"


def test_crosses_day(spark):
    stamps = [pd.Timestamp("2022-03-01 15:55"), pd.Timestamp("2022-03-02 09:30")]
    rows = labelled(spark, [100.0, 105.0], stamps=stamps)
    assert rows[0]["invalid_cross_trading_day"] and not rows[0]["invalid_missing_future"]
    assert rows[0]["horizon_end_timestamp"] == dt.datetime(2022, 3, 2, 9, 30) and rows[0]["label"] is None


def test_crosses_split(spark):
    b = B.SplitBoundaries("2022-01-01", "2022-03-01 09:35", "2022-03-01 09:35", "2022-09-01", "2022-12-01")
    bars = B.assign_split(make_bars(spark, [100.0, 105.0]).drop("split"), b)
    rows = L.direction_labels(bars, L.LabelPolicy(1, 10.0, 5), b).orderBy("timestamp").collect()
    assert rows[0]["invalid_cross_split"] and rows[0]["label"] is None


def test_gap_is_irregular(spark):
    rows = labelled(spark, [100.0, 105.0], stamps=[pd.Timestamp("2022-03-01 09:30"), pd.Timestamp("2022-03-01 09:40")])
    assert rows[0]["invalid_irregular_horizon"] and rows[0]["future_cumulative_return"] is None


def test_sparse_days_reach_over_several(spark):
    """k rows ahead may lie several one-bar days later: compare with a plain shift."""
    stamps = [pd.Timestamp(f"2022-03-0{d} 09:30") for d in range(1, 8)]
    rows = labelled(spark, [float(100 + i) for i in range(7)], k=3, stamps=stamps)
    assert [r["horizon_end_timestamp"] for r in rows] == [s.to_pydatetime() for s in stamps[3:]] + [None] * 3


def test_full_session_has_78_bars(spark):
    stamps = pd.date_range("2022-03-01 09:30", "2022-03-01 16:00", freq="1min")
    df = make_bars(spark, [100.0] * len(stamps), stamps=list(stamps)).drop("split", "trading_day")
    out = B.resample(df, 5, session=(570, 960)).orderBy("timestamp").collect()
    assert len(out) == 78
    assert out[0]["timestamp"] == dt.datetime(2022, 3, 1, 9, 30) and out[-1]["timestamp"] == dt.datetime(2022, 3, 1, 15, 55)


def test_resample_first_skips_blank(spark):
    df = spark.createDataFrame([("A", dt.datetime(2022, 3, 1, 9, 30), None, 2.0, 1.0, 1.5, 5.0),
                                ("A", dt.datetime(2022, 3, 1, 9, 31), 1.2, 3.0, 1.0, None, 5.0)], schema.BARS)
    row = B.resample(df, 5).first()
    assert (row["open"], row["high"], row["close"], row["volume"]) == (1.2, 3.0, 1.5, 10.0)


def test_features_match_pandas(spark):
    n = 60
    close = [100 + 3 * math.sin(0.7 * i) + 0.05 * i for i in range(n)]
    rows = FT.add_features(make_bars(spark, close)).orderBy("timestamp").toPandas()
    s = pd.Series(close)
    lr = pd.Series([float("nan")] + [math.log(close[i] / close[i - 1]) for i in range(1, n)])
    pd.testing.assert_series_equal(rows["log_return"], lr, check_names=False, rtol=1e-12)
    pd.testing.assert_series_equal(rows["rolling_volatility_20"], lr.rolling(20, min_periods=5).std(), check_names=False, rtol=1e-9)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    hist = (macd - macd.ewm(span=9, adjust=False).mean()) / s.rolling(20, min_periods=10).std()
    pd.testing.assert_series_equal(rows["normalized_macd_hist"], hist, check_names=False, rtol=1e-8, atol=1e-10)
    d = s.diff()
    rs = d.clip(lower=0).rolling(14, min_periods=5).mean() / (-d).clip(lower=0).rolling(14, min_periods=5).mean()
    pd.testing.assert_series_equal(rows["rsi_14"], 1 - 1 / (1 + rs), check_names=False, rtol=1e-9)


def test_folds_are_expanding_and_disjoint(spark):
    rows = [(f"A|{d}|{i}", "A", dt.datetime(2022, 3, d, 9, 30 + i), f"2022-03-{d:02d}", "train", i % 2) for d in range(1, 9) for i in range(4)]
    ev = spark.createDataFrame(rows, "sample_id string, ticker string, target_timestamp timestamp_ntz, trading_day string, split string, label int")
    folds = FD.train_inner_folds(ev, 3).orderBy("fold_id").collect()
    assert [(f["n_train_samples"], f["n_eval_samples"], f["event_overlap_count"]) for f in folds] == [(8, 8, 0), (16, 8, 0), (24, 8, 0)]
    assert folds[0]["train_end_exclusive"] == dt.datetime(2022, 3, 3, 9, 30)


@pytest.mark.parametrize("n,cap", [(37, 10), (100, 7), (501, 123), (5, 10), (9, 1)])
def test_even_stride_positions(spark, n, cap):
    import numpy as np

    rows = [(f"{i:05d}", "A", dt.datetime(2022, 3, 1) + dt.timedelta(minutes=i), 1) for i in range(n)]
    ev = spark.createDataFrame(rows, "sample_id string, ticker string, target_timestamp timestamp_ntz, label int")
    got = sorted(int(r["sample_id"]) for r in FD.even_stride_cap(ev, cap).collect())
    want = list(range(n)) if n <= cap else sorted(set(np.linspace(0, n - 1, cap, dtype=int).tolist()))
    assert got == want


def test_windows_stay_in_the_day_and_finite(spark):
    bars = make_bars(spark, [100.0 + i for i in range(8)])
    f = FT.add_features(bars)
    ev = bars.select(F.concat_ws("|", "ticker", "timestamp").alias("sample_id"), "ticker", "trading_day",
                     F.col("timestamp").alias("target_timestamp"), F.lit(1).alias("label"), "split")
    w = WN.window_dataset(f, ev, ["log_return"], 3, "x").orderBy("window_start_position").collect()
    assert [r["window_start_position"] for r in w] == [1, 2, 3, 4, 5] and all(len(r["features"]) == 3 for r in w)


def test_minute_files_with_and_without_header_and_bom(spark, tmp_path):
    (tmp_path / "GA.txt").write_text("﻿Date,Time,Open,High,Low,Close,Volume\n03/01/2022,09:30,1,2,0.5,1.5,10\n", encoding="utf-8")
    (tmp_path / "GB_1min.txt").write_text("03/01/2022,09:31,1,2,0.5,1.5,10\n", encoding="utf-8")
    rows = read_minute_files(spark, f"{tmp_path}/*.txt").orderBy("ticker").collect()
    assert [(r["ticker"], r["timestamp"].minute, r["volume"]) for r in rows] == [("GA", 30, 10.0), ("GB", 31, 10.0)]


def test_bad_header_and_bad_number_fail(spark, tmp_path):
    (tmp_path / "GC.txt").write_text("Date,Time,Open,High,Low,Close,Size\n03/01/2022,09:30,1,2,0.5,1.5,10\n")
    with pytest.raises(Exception):
        read_minute_files(spark, f"{tmp_path}/GC.txt").collect()
    (tmp_path / "GD.txt").write_text("03/01/2022,09:30,1,2,0.5,abc,10\n")
    with pytest.raises(Exception):
        read_minute_files(spark, f"{tmp_path}/GD.txt").collect()


def test_guards_raise(spark):
    bars = make_bars(spark, [100.0, 101.0])
    with pytest.raises(schema.ContractError):
        G.require_rows(bars.filter("close > 1000"), "none")
    with pytest.raises(schema.ContractError):
        G.assert_train_only(bars, ["timestamp"], "2022-03-02", "2022-04-01")
    with pytest.raises(schema.ContractError):
        schema.assert_schema(bars, schema.BARS, "bars")
    two = bars.withColumn("d", F.col("timestamp").cast("string"))
    with pytest.raises(schema.ContractError):
        G.require_single_domain(two, "d", "x")
