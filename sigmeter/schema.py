"""Column contracts and the checks that fail closed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_N = T.TimestampNTZType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


BARS = _struct(ticker=_S, timestamp=_N, open=_D, high=_D, low=_D, close=_D, volume=_D)

# Raw minute files: header text and formats are fixed by the data vendor.
RAW_MINUTE = _struct(Date=_S, Time=_S, Open=_S, High=_S, Low=_S, Close=_S, Volume=_S)

EVENT_INDEX = _struct(
    sample_id=_S, ticker=_S, target_timestamp=_N, trading_day=_S, split=_S, horizon_k=_I,
    horizon_end_timestamp=_N, label=_I, future_cumulative_return=_D, valid_label=_B,
    invalid_missing_future=_B, invalid_cross_trading_day=_B, invalid_irregular_horizon=_B,
    invalid_cross_split=_B, invalid_no_trade_band=_B,
)
EVENT_REQUIRED = ["sample_id", "ticker", "target_timestamp", "trading_day", "split", "label",
                  "valid_label"]

INVALID_FLAGS = ["invalid_missing_future", "invalid_cross_trading_day", "invalid_irregular_horizon",
                 "invalid_cross_split", "invalid_no_trade_band"]

PREDICTIONS = _struct(
    candidate_role=_S, candidate_id=_S, model_family=_S, hpo_profile_id=_S, seed=_I, sample_id=_S,
    ticker=_S, target_timestamp=_N, trading_day=_S, y_true=_I, p_up=_D, y_pred=_I, scope=_S,
)


class ContractError(ValueError):
    """A table broke its column, key or value contract."""


def assert_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{what}: missing columns {missing}")
    return df


def assert_schema(df: DataFrame, contract: T.StructType, what: str) -> DataFrame:
    """Names, order and types must equal the contract (nullability is not compared)."""
    seen = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in contract]
    if seen != want:
        raise ContractError(f"{what}: schema {seen} differs from contract {want}")
    return df


def require(df: DataFrame, checks: dict[str, Column], what: str) -> DataFrame:
    """Evaluate named aggregate booleans in one pass; raise on the first that is not true."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()]).first()
    failed = [k for k in checks if not row[k]]
    if failed:
        raise ContractError(f"{what}: failed {failed}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ContractError(f"{what}: duplicate keys on {keys}")
    return df
