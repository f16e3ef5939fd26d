"""Query registry and the shared SQL fragments of the oracle.

``query(name, sql)`` registers a Spark callable and, where SQL can express it, the ANSI text
DuckDB runs on the same Parquet views. Fragments are named CTEs; ``sql`` texts name the ones
they need and ``with_ctes`` puts them in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..sources import predictions as P, tape as TP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn
    return wrap


STORED: set[str] = set()


def cte(name: str, body: str, stored: bool = False) -> None:
    """``stored``: to be computed once, where it is read several times."""
    CTES[name] = body
    if stored:
        STORED.add(name)


def with_ctes(body: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(re.sub(rf"\b{name}\b", "", CTES[name]))
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    head = ", ".join(f"{n} AS {'MATERIALIZED ' * (n in STORED)}({CTES[n]})" for n in order)
    text = body.lstrip()
    if text[:5].upper() == "WITH ":
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to fixed digits, so that both engines print the same number."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.round(c, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*out)


# ---- SQL helpers -----------------------------------------------------------------------

def r(expr: str, digits: int = 9) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0::DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def h01(expr: str) -> str:
    return hx(f"sha256({expr})", 1)


def hx(hexed: str, start: int) -> str:
    return f"((('0x' || substr({hexed}, {start}, 13))::BIGINT)::DOUBLE / 4503599627370496::DOUBLE)"


def f1(n: str = "n", p: str = "p", pp: str = "pp", tp: str = "tp") -> str:
    up = f"coalesce({div(f'2*({tp})', f'({p})+({pp})')}, 0)"
    down = f"coalesce({div(f'2*(({n})-({p})-({pp})+({tp}))', f'2*({n})-({p})-({pp})')}, 0)"
    return f"(CASE WHEN ({n}) > 0 THEN ({up} + {down}) / 2 END)"


def bf1(n: str = "n", p: str = "p", bp: str = "bp", btp: str = "btp") -> str:
    return f1(n, p, bp, btp)


def delta() -> str:
    return f"({f1()} - {bf1()})"


def cf1(constant: int, n: str = "n", p: str = "p") -> str:
    return f1(n, p, n, p) if constant == 1 else f1(n, p, "0", "0")


SUMS_SQL = ("count(*)::BIGINT AS n, sum(y_true)::BIGINT AS p, sum(y_pred)::BIGINT AS pp, "
            "sum(y_true*y_pred)::BIGINT AS tp, sum(base_pred)::BIGINT AS bp, "
            "sum(y_true*base_pred)::BIGINT AS btp, sum(y_pred*base_pred)::BIGINT AS q11")
RESUM_SQL = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("n", "p", "pp", "tp", "bp", "btp", "q11"))


def t_table(df: str) -> str:
    from ..functions.student_t import t975
    pairs = " ".join(f"WHEN {i} THEN {t975(i)!r}::DOUBLE" for i in range(1, 251))
    return f"(CASE {df} {pairs} END)"


def lcb(x: str) -> str:
    n = f"count({x})"
    return (f"(CASE WHEN {n} <= 1 THEN avg({x}) ELSE avg({x}) - {t_table(f'({n} - 1)')} "
            f"* stddev_samp({x}) / sqrt({n}::DOUBLE) END)")


# ---- tape fragments --------------------------------------------------------------------

cte("tape", """SELECT event_id, event_type AS ticker, ts AS "timestamp", value AS price,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS size FROM events""")
cte("rawbars", """SELECT ticker, strftime("timestamp", '%Y-%m-%d') AS trading_day,
  time_bucket(INTERVAL '60 minutes', "timestamp") AS "timestamp",
  arg_min(price, row("timestamp", event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row("timestamp", event_id)) AS close, sum(size) AS volume
  FROM tape GROUP BY 1, 2, 3""")


def split_case(ts: str) -> str:
    b = TP.SPLITS
    return (f"CASE WHEN {ts} >= TIMESTAMP '{b.train_start}' AND {ts} < TIMESTAMP '{b.train_end}' THEN 'train' "
            f"WHEN {ts} >= TIMESTAMP '{b.validation_start}' AND {ts} < TIMESTAMP '{b.validation_end}' THEN 'validation' "
            f"WHEN {ts} >= TIMESTAMP '{b.validation_end}' AND {ts} < TIMESTAMP '{b.data_end}' "
            "THEN 'closed_holdout_test' ELSE 'outside' END")


cte("bars", f"""SELECT *, {split_case('"timestamp"')} AS split FROM rawbars""")


def labels_sql(k: int, band_bps: str, src: str = "bars", extra: str = "") -> str:
    """Labels with plain ticker-wide leads: an independent form of the day-local operator."""
    return f"""
  SELECT ticker, trading_day, "timestamp", open, high, low, close, volume, split{extra}, {k} AS horizon_k,
    hts AS horizon_end_timestamp, miss AS invalid_missing_future, cross_day AS invalid_cross_trading_day,
    irr AS invalid_irregular_horizon, cross_split AS invalid_cross_split,
    (ok AND abs(fr) <= {band_bps} / 10000.0::DOUBLE) AS invalid_no_trade_band,
    CASE WHEN ok AND fr > {band_bps} / 10000.0::DOUBLE THEN 1
         WHEN ok AND fr < -({band_bps} / 10000.0::DOUBLE) THEN 0 END AS label,
    (CASE WHEN ok AND fr > {band_bps} / 10000.0::DOUBLE THEN 1
         WHEN ok AND fr < -({band_bps} / 10000.0::DOUBLE) THEN 0 END) IS NOT NULL AS valid_label,
    CASE WHEN ok AND abs(fr) > {band_bps} / 10000.0::DOUBLE THEN fr END AS future_cumulative_return,
    ticker || '|' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS sample_id, fr, ok
  FROM (SELECT *, NOT (miss OR cross_day OR irr OR cross_split) AND fr IS NOT NULL AS ok FROM (
    SELECT *, (hts IS NULL OR (same_day AND fr IS NULL)) AS miss, NOT same_day AS cross_day,
      (same_day AND epoch_us(hts) - epoch_us("timestamp") <> {k * 60 * 60000000}::BIGINT) AS irr,
      (hts IS NOT NULL AND NOT (same_day AND fr IS NULL) AND split <> {split_case('hts')}) AS cross_split
    FROM (SELECT *, coalesce(hday = trading_day, false) AS same_day,
        CASE WHEN hday = trading_day THEN hclose / nullif(close, 0) - 1.0::DOUBLE END AS fr
      FROM (SELECT *, lead("timestamp", {k}) OVER w AS hts, lead(trading_day, {k}) OVER w AS hday,
          lead(close, {k}) OVER w AS hclose FROM {src}
          WINDOW w AS (PARTITION BY ticker ORDER BY "timestamp")))))"""


cte("labelled", labels_sql(TP.HORIZON_K, f"{TP.BAND_BPS}::DOUBLE"))


def _ewm(lst: str, alpha: float) -> str:
    return f"list_reduce({lst}, lambda a, x: a * {1.0 - alpha!r}::DOUBLE + x * {alpha!r}::DOUBLE)"


def _gate(value: str, counted: str, n: int, minimum: int) -> str:
    w = f"w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN count({counted}) OVER ({w}) >= {minimum} THEN {value} OVER ({w}) END"


cte("feat1", """SELECT *, CASE WHEN close / nullif(prev, 0) > 0 THEN ln(close / nullif(prev, 0)) END AS log_return,
    CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss
  FROM (SELECT *, lag(close) OVER w AS prev, close - lag(close) OVER w AS d,
    list(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist FROM bars
    WINDOW w AS (PARTITION BY ticker, trading_day ORDER BY "timestamp"))""")
cte("feat2", f"""SELECT *, {_ewm('hist', 2.0 / 13)} - {_ewm('hist', 2.0 / 27)} AS macd FROM feat1""")
cte("feat3", f"""SELECT *, list(macd) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mhist,
    {_gate('stddev_samp(log_return)', 'log_return', 20, 5)} AS rolling_volatility_20,
    {_gate('avg(gain)', 'gain', 14, 5)} AS ag, {_gate('avg(loss)', 'loss', 14, 5)} AS al,
    {_gate('avg(close)', 'close', 20, 10)} AS m, {_gate('stddev_samp(close)', 'close', 20, 10)} AS s,
    {_gate('avg(volume)', 'volume', 20, 5)} AS mv
  FROM feat2 WINDOW w AS (PARTITION BY ticker, trading_day ORDER BY "timestamp")""")
cte("features", f"""SELECT ticker, trading_day, "timestamp", split, open, close, log_return,
    CASE WHEN close / nullif(open, 0) > 0 THEN ln(close / nullif(open, 0)) END AS close_to_open_return,
    (high - low) / nullif(close, 0) AS high_low_range, rolling_volatility_20,
    CASE WHEN al = 0 AND ag > 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + ag / nullif(al, 0)) END AS rsi_14,
    (close - (m - 2 * s)) / nullif(4 * s, 0) AS bollinger_pctb,
    (macd - {_ewm('mhist', 0.2)}) / nullif(s, 0) AS normalized_macd_hist,
    volume / nullif(mv, 0) - 1 AS normalized_volume_20,
    sin(2 * pi() * (hour("timestamp") * 60 + minute("timestamp") - 570) / 390) AS time_of_day_sin,
    cos(2 * pi() * (hour("timestamp") * 60 + minute("timestamp") - 570) / 390) AS time_of_day_cos
  FROM feat3""")

# ---- prediction fragments --------------------------------------------------------------

cte("facts", """SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS sample_id,
  'T' || (l_suppkey % 5) AS ticker, l_shipdate + to_hours(9 + l_linenumber) AS target_timestamp,
  strftime(l_shipdate, '%Y-%m-%d') AS trading_day, year(l_shipdate)::INTEGER AS yr,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y_true, 'set_' || l_linestatus AS candidate_id,
  'profile_' || l_returnflag AS hpo_profile_id FROM lineitem""")
cte("priors", """SELECT a.yr, (SELECT sum(y_true)::DOUBLE / count(*) FROM facts b WHERE b.yr < a.yr) AS prior
  FROM (SELECT DISTINCT yr FROM facts) a""")
cte("families", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {v}::DOUBLE)" for k, v in P.FAMILIES.items()) + ") t(model_family, edge)")
cte("seeds", "SELECT unnest([" + ", ".join(map(str, P.SEEDS)) + "])::INTEGER AS seed")
_scored = f"""SELECT model_family, 'wf_' || yr AS period_id, seed, sample_id, ticker, target_timestamp,
  trading_day, y_true, p_up, CASE WHEN p_up >= 0.5 THEN 1 ELSE 0 END AS y_pred,
  CASE WHEN bu < prior THEN 1 ELSE 0 END AS base_pred, prior, candidate_id, hpo_profile_id FROM (
  SELECT f.*, m.model_family, s.seed, q.prior,
    ({h01("m.model_family || '|' || s.seed || '|' || f.sample_id")} + m.edge * f.y_true) / (1 + m.edge) AS p_up,
    {h01("'dummy|' || s.seed || '|' || f.sample_id")} AS bu
  FROM facts f JOIN priors q ON q.yr = f.yr, families m, seeds s
  WHERE f.target_timestamp >= TIMESTAMP '{P.WARMUP_END}' AND {{where}})"""
cte("scored_all", _scored.format(where="true"))
cte("scored_one", _scored.format(where=f"m.model_family = '{P.PRIMARY}'"))

cte("cells_all", f"""SELECT model_family, seed, period_id, ticker, trading_day, {SUMS_SQL}
  FROM scored_all GROUP BY ALL""")
cte("cells_one", f"""SELECT model_family, seed, period_id, ticker, trading_day, {SUMS_SQL}
  FROM scored_one GROUP BY ALL""")
cte("day_terciles", """SELECT ticker, trading_day,
  CASE least(3, greatest(1, ceil(rk::DOUBLE / nd::DOUBLE * 3)))::INTEGER WHEN 1 THEN 'low' WHEN 2 THEN 'mid' ELSE 'high' END AS activity_tercile
  FROM (SELECT ticker, trading_day, row_number() OVER (PARTITION BY ticker ORDER BY nr, trading_day) AS rk,
    count(*) OVER (PARTITION BY ticker) AS nd
    FROM (SELECT ticker, trading_day, count(*) AS nr FROM scored_one GROUP BY 1, 2))""")
