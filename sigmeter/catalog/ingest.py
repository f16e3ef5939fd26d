"""Queries over scans, guards, joins, bars, features, labels and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import confusion as C, scalar as S
from ..operators import (bars as B, features as FT, folds as FD, guards as G, integrity as Q, joins as J,
                         labels as L, windows as WN)
from ..session import scratch_path
from ..sources import predictions as P, tape as TP
from ..sources.minute_files import read_minute_files
from ..sources.tables import read_event_index, read_table, write_table
from .base import cte, f1, labels_sql, query, r, rounded

POLICY = L.LabelPolicy(TP.HORIZON_K, TP.BAND_BPS, TP.INTERVAL_MINUTES)


def labelled(spark, sf):
    return L.direction_labels(TP.bars(spark, sf), POLICY, TP.SPLITS)


@query("flagship_majority_macro_f1", f"""
  WITH m AS (SELECT CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS maj FROM labelled
             WHERE valid_label AND split = 'train'),
  e AS (SELECT ticker, count(*)::BIGINT AS n, sum(label)::BIGINT AS p, sum(maj)::BIGINT AS pp,
        sum(label * maj)::BIGINT AS tp FROM labelled, m WHERE valid_label AND split = 'validation' GROUP BY 1)
  SELECT ticker, n, p AS support_up, {r(f1())} AS macro_f1 FROM e""")
def flagship(spark, sf):
    """Majority baseline learned on train labels, scored per ticker on validation labels."""
    lab = labelled(spark, sf).filter("valid_label").select("ticker", "split", "label")
    counts = lab.filter(F.col("split").isin("train", "validation")).groupBy("ticker", "split").agg(
        F.count("*").alias("n"), F.sum("label").alias("p"))
    maj = counts.filter("split = 'train'").agg(
        F.when(F.sum("p") * 2 > F.sum("n"), 1).otherwise(0).alias("maj"))
    e = counts.filter("split = 'validation'").crossJoin(F.broadcast(maj))  # one row
    return e.select("ticker", "n", F.col("p").alias("support_up"),
                    F.round(C.constant_f1(F.col("maj")), 9).alias("macro_f1"))


@query("d1_resample_bars", f"""SELECT ticker, trading_day, "timestamp", open, high, low, close,
  {r('volume', 6)} AS volume FROM rawbars""")
def d1(spark, sf):
    return rounded(B.resample(TP.ticks_as_minutes(spark, sf), TP.INTERVAL_MINUTES, tie="tie"), 6)


@query("f1_direction_labels", f"""SELECT sample_id, ticker, "timestamp" AS target_timestamp, trading_day,
  split, horizon_k, horizon_end_timestamp, label, {r('future_cumulative_return')} AS future_cumulative_return,
  valid_label, invalid_missing_future, invalid_cross_trading_day, invalid_irregular_horizon,
  invalid_cross_split, invalid_no_trade_band FROM labelled""")
def f1_labels(spark, sf):
    return rounded(L.event_index(labelled(spark, sf)))


# ---- A: sources and sinks --------------------------------------------------------------

cte("minute_bars", """SELECT ticker, date_trunc('minute', "timestamp") AS "timestamp",
  arg_min(price, row("timestamp", event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row("timestamp", event_id)) AS close, sum(size) AS volume FROM tape GROUP BY 1, 2""")


@query("a1_read_minute_files", """SELECT ticker, "timestamp", open, high, low, close, volume FROM minute_bars""")
def a1(spark, sf):
    """The tape written as raw minute text files (with headers), read back through the raw reader."""
    path = scratch_path(spark, "raw-minutes")
    m = B.resample(TP.ticks_as_minutes(spark, sf), 1, tie="tie")
    (m.select(F.date_format("timestamp", "MM/dd/yyyy").alias("Date"),
              F.date_format("timestamp", "HH:mm").alias("Time"), F.col("open").alias("Open"),
              F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
              F.col("volume").alias("Volume"), F.col("ticker").alias("symbol"))
     .write.partitionBy("symbol").option("header", True).csv(path))
    return read_minute_files(spark, f"{path}/symbol=*/", r"symbol=([^/]+)/")


@query("a4_load_event_index", f"""SELECT sample_id, ticker, "timestamp" AS target_timestamp, trading_day, split,
  label, valid_label FROM labelled""")
def a4(spark, sf):
    path = scratch_path(spark, "event-index")
    write_table(L.event_index(labelled(spark, sf)), path, schema.EVENT_INDEX)
    return read_event_index(spark, path).select(*schema.EVENT_REQUIRED)


@query("a5_train_validation_bars", f"""SELECT ticker, trading_day, "timestamp", open, high, low, close,
  {r('volume', 6)} AS volume, split FROM bars WHERE split IN ('train', 'validation')""")
def a5(spark, sf):
    return rounded(B.keep_open_splits(TP.bars(spark, sf)), 6)


GUARD_END = "2024-01-25 00:00:00"


@query("a6_guarded_bars", f"""SELECT ticker, trading_day, "timestamp", open, high, low, close,
  {r('volume', 6)} AS volume, split FROM bars WHERE "timestamp" < TIMESTAMP '{GUARD_END}'""")
def a6(spark, sf):
    return rounded(TP.bars(spark, sf, end=GUARD_END), 6)


@query("a7_projected_read", """SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n,
  sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2""")
def a7(spark, sf):
    return read_table(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_linestatus", "l_quantity"]).groupBy(
        "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("a8_table_sink", """SELECT split, ticker, count(*)::BIGINT AS n, count_if(valid_label)::BIGINT AS n_valid
  FROM labelled GROUP BY 1, 2""")
def a8(spark, sf):
    """The event index through the partitioned sink; read back from its partitions."""
    path = scratch_path(spark, "sink")
    write_table(L.event_index(labelled(spark, sf)), path, schema.EVENT_INDEX, partition_by=["split"],
                sort_by=["ticker", "target_timestamp"])
    return spark.read.parquet(path).groupBy("split", "ticker").agg(
        F.count("*").alias("n"), F.count_if("valid_label").alias("n_valid"))


@query("a11_date_range_profile", """SELECT ticker, min(target_timestamp) AS first_ts, max(target_timestamp) AS last_ts,
  count(*)::BIGINT AS n_rows, count_if(target_timestamp >= TIMESTAMP '2000-01-01')::BIGINT AS rows_after_boundary
  FROM facts GROUP BY 1""")
def a11(spark, sf):
    t = F.col("target_timestamp")
    return P.facts(spark, sf).groupBy("ticker").agg(
        F.min(t).alias("first_ts"), F.max(t).alias("last_ts"), F.count("*").alias("n_rows"),
        F.count_if(t >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("rows_after_boundary"))


@query("a11_rows_per_year", """SELECT ticker, yr AS year, count(*)::BIGINT AS n_rows FROM facts GROUP BY 1, 2""")
def a11y(spark, sf):
    return P.facts(spark, sf).groupBy("ticker", "year").agg(F.count("*").alias("n_rows"))


# ---- B: filters and guards -------------------------------------------------------------

@query("b1_session_filter", """SELECT ticker,
  count_if(s >= 32400 AND s <= 61200)::BIGINT AS with_close, count_if(s >= 32400 AND s < 61200)::BIGINT AS without_close
  FROM (SELECT ticker, hour("timestamp") * 3600 + minute("timestamp") * 60 + second("timestamp") AS s FROM bars) GROUP BY 1""")
def b1(spark, sf):
    b = TP.bars(spark, sf)
    closed = B.session_filter(b, 540, 1020, True).groupBy("ticker").agg(F.count("*").alias("with_close"))
    half = B.session_filter(b, 540, 1020, False).groupBy("ticker").agg(F.count("*").alias("without_close"))
    return closed.join(half, "ticker")


@query("b1_session_bars", f"""SELECT ticker, "timestamp", open, close, {r('volume', 6)} AS volume FROM rawbars
  WHERE hour("timestamp") >= 9 AND hour("timestamp") < 17""")
def b1b(spark, sf):
    b = B.resample(TP.ticks_as_minutes(spark, sf), TP.INTERVAL_MINUTES, session=(540, 1020), tie="tie")
    return rounded(b.select("ticker", "timestamp", "open", "close", "volume"), 6)


@query("b2_assign_split", """SELECT ticker, split, count(*)::BIGINT AS n FROM bars GROUP BY 1, 2""")
def b2(spark, sf):
    return TP.bars(spark, sf).groupBy("ticker", "split").agg(F.count("*").alias("n"))


@query("b3_keep_open_splits", """SELECT split, count(*)::BIGINT AS n FROM bars
  WHERE split IN ('train', 'validation') GROUP BY 1""")
def b3(spark, sf):
    return B.keep_open_splits(TP.bars(spark, sf)).groupBy("split").agg(F.count("*").alias("n"))


@query("b4_valid_train_events", """SELECT sample_id, ticker, "timestamp" AS target_timestamp, trading_day, split, label
  FROM labelled WHERE split = 'train' AND valid_label""")
def b4(spark, sf):
    return G.require_rows(G.valid_events(L.event_index(labelled(spark, sf)), "train"), "train events")


@query("b5_text_flag", """SELECT flag, count(*)::BIGINT AS n FROM (SELECT
  lower(trim(json_extract_string(props, '$.k'))) IN ('1', 'true', 't', 'yes', 'y') AS flag FROM events) GROUP BY 1""")
def b5(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select(S.text_flag(F.get_json_object("props", "$.k")).alias("flag")).groupBy("flag").agg(
        F.count("*").alias("n"))


@query("b6_train_domain_bounds", f"""SELECT min(target_timestamp) AS min_target_timestamp, max(target_timestamp) AS max_target_timestamp,
  min(horizon_end_timestamp) AS min_horizon_end_timestamp, max(horizon_end_timestamp) AS max_horizon_end_timestamp,
  string_agg(DISTINCT split, ',') AS splits,
  min(target_timestamp) >= TIMESTAMP '2024-01-01' AND max(target_timestamp) < TIMESTAMP '2024-01-21'
  AND min(horizon_end_timestamp) >= TIMESTAMP '2024-01-01' AND max(horizon_end_timestamp) < TIMESTAMP '2024-01-21' AS inside
  FROM (SELECT *, "timestamp" AS target_timestamp FROM labelled WHERE split = 'train' AND valid_label)""")
def b6(spark, sf):
    ev = L.event_index(labelled(spark, sf)).filter("split = 'train' and valid_label")
    return G.domain_bounds(ev, ["target_timestamp", "horizon_end_timestamp"], "2024-01-01", "2024-01-21")


_GATE_VARIANTS = ("as_is", "short", "wrong_role", "wrong_scope", "missing_seed", "past_holdout")


@query("b7_dump_gate", f"""WITH d AS (SELECT v.variant, seed, CASE WHEN v.variant = 'wrong_role' AND ticker = 'T2' THEN 'fallback' ELSE 'primary' END AS candidate_role,
    CASE WHEN v.variant = 'wrong_scope' AND ticker = 'T3' THEN 'train_inner' ELSE 'validation_only' END AS scope,
    CASE WHEN v.variant = 'past_holdout' AND target_timestamp = (SELECT max(target_timestamp) FROM scored_one) THEN TIMESTAMP '{P.HOLDOUT}' ELSE target_timestamp END AS t
    FROM scored_one, (SELECT unnest({list(_GATE_VARIANTS)}) AS variant) v WHERE NOT (v.variant = 'missing_seed' AND seed = 202) AND NOT (v.variant = 'short' AND ticker = 'T4'))
  SELECT variant, count(*)::BIGINT AS n_rows, count(*) = (SELECT count(*) FROM scored_one) AS rows_ok, count_if(candidate_role <> 'primary') = 0 AS role_ok, count_if(scope <> 'validation_only') = 0 AS scope_ok,
  string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) = '101,202' AS seeds_ok, max(t) < TIMESTAMP '{P.HOLDOUT}' AS holdout_ok FROM d GROUP BY 1""")
def b7(spark, sf):
    """The gate on the dump as it is and on five with one planted fault each."""
    dump = schema.assert_schema(P.dump(spark, sf), schema.PREDICTIONS, "prediction dump")
    whole = dump.agg(F.count("*").alias("n"), F.max("target_timestamp").alias("t")).first()
    faults = {
        "as_is": dump, "short": dump.filter("ticker <> 'T4'"), "missing_seed": dump.filter("seed <> 202"),
        "wrong_role": dump.withColumn("candidate_role", F.when(F.col("ticker") == "T2", "fallback").otherwise(F.col("candidate_role"))),
        "wrong_scope": dump.withColumn("scope", F.when(F.col("ticker") == "T3", "train_inner").otherwise(F.col("scope"))),
        "past_holdout": dump.withColumn("target_timestamp", F.when(F.col("target_timestamp") == F.lit(whole["t"]), F.lit(P.HOLDOUT).cast("timestamp_ntz")).otherwise(F.col("target_timestamp")))}
    out = None
    for name in _GATE_VARIANTS:
        row = G.dump_checks(faults[name], P.SEEDS, P.HOLDOUT, whole["n"]).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("b8_dump_derive", f"""SELECT ticker, year(target_timestamp)::VARCHAR AS calendar_year,
  year(target_timestamp) || 'Q' || quarter(target_timestamp) AS calendar_quarter,
  strftime(target_timestamp, '%Y-%m') AS calendar_month, strftime(target_timestamp, '%H') AS time_of_day_hour,
  count(*)::BIGINT AS n, sum((y_true = y_pred)::INTEGER)::BIGINT AS n_correct, {r('avg(greatest(p_up, 1 - p_up))')} AS mean_confidence
  FROM scored_one GROUP BY 1, 2, 3, 4, 5""")
def b8(spark, sf):
    d = G.derive_dump(P.dump(spark, sf))
    return rounded(d.groupBy("ticker", "calendar_year", "calendar_quarter", "calendar_month", "time_of_day_hour").agg(
        F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.avg("confidence").alias("mean_confidence")))


@query("b9_top_label_confidence", f"""SELECT seed, ticker, {r('avg(c)')} AS mean_confidence, {r('min(c)')} AS min_confidence,
  {r('max(c)')} AS max_confidence FROM (SELECT seed, ticker, greatest(p_up, 1 - p_up) AS c FROM scored_one) GROUP BY 1, 2""")
def b9(spark, sf):
    c = P.scored(spark, sf).select("seed", "ticker", G.confidence(F.col("p_up")).alias("c"))
    return rounded(c.groupBy("seed", "ticker").agg(F.avg("c").alias("mean_confidence"),
                   F.min("c").alias("min_confidence"), F.max("c").alias("max_confidence")))


@query("b11_single_domain", """SELECT ticker, count(DISTINCT scope)::BIGINT AS n_domains, count(DISTINCT scope) <= 1 AS single_domain
  FROM (SELECT ticker, CASE WHEN ticker IN ('T1', 'T3') AND seed = 202 THEN 'train_inner' ELSE 'validation_only' END AS scope FROM scored_one) GROUP BY 1""")
def b11(spark, sf):
    """Domains per ticker of a dump in which two tickers mix two domains."""
    mixed = F.col("ticker").isin("T1", "T3") & (F.col("seed") == 202)
    d = P.dump(spark, sf).withColumn("scope", F.when(mixed, "train_inner").otherwise(F.col("scope")))
    return d.groupBy("ticker").agg(F.count_distinct("scope").alias("n_domains"), (F.count_distinct("scope") <= 1).alias("single_domain"))


# ---- E/F: windows, labels, folds -------------------------------------------------------

_FEATS = ["log_return", "close_to_open_return", "high_low_range", "rolling_volatility_20", "rsi_14",
          "bollinger_pctb", "normalized_macd_hist", "normalized_volume_20", "time_of_day_sin", "time_of_day_cos"]


def featured(spark, sf):
    return FT.add_features(TP.bars(spark, sf))


@query("e10_feature_frame", "SELECT ticker, trading_day, \"timestamp\", " + ", ".join(
    f"{r(c, 6)} AS {c}" for c in _FEATS) + " FROM features")
def e10(spark, sf):
    return rounded(featured(spark, sf).select("ticker", "trading_day", "timestamp", *_FEATS), 6)


def _feature_query(code: str, name: str) -> None:
    @query(f"{code}_{name}", f'SELECT ticker, "timestamp", {r(name, 6)} AS {name} FROM features')
    def one(spark, sf):
        return rounded(featured(spark, sf).select("ticker", "timestamp", name), 6)


for _code, _name in zip(("e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8", "e9"), _FEATS):
    _feature_query(_code, _name)


@query("e11_horizon_lead", """SELECT ticker, "timestamp", lead("timestamp", 2) OVER w AS horizon_end_timestamp
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY "timestamp")""")
def e11(spark, sf):
    return L.forward_returns(TP.bars(spark, sf), 2, 60, TP.SPLITS).select("ticker", "timestamp", "horizon_end_timestamp")


@query("f2_label_validity", """SELECT ticker, split, count(*)::BIGINT AS rows, count_if(valid_label)::BIGINT AS valid_label_rows,
  count_if(label = 1)::BIGINT AS up_labels, count_if(label = 0)::BIGINT AS down_labels,
  count_if(invalid_missing_future)::BIGINT AS invalid_missing_future, count_if(invalid_cross_trading_day)::BIGINT AS invalid_cross_trading_day,
  count_if(invalid_irregular_horizon)::BIGINT AS invalid_irregular_horizon, count_if(invalid_cross_split)::BIGINT AS invalid_cross_split,
  count_if(invalid_no_trade_band)::BIGINT AS invalid_no_trade_band FROM labelled
  WHERE split IN ('train', 'validation') GROUP BY 1, 2""")
def f2(spark, sf):
    return L.validity_summary(labelled(spark, sf))


CELLS = [(1, 500.0), (2, 250.0), (2, 500.0), (2, 1000.0), (4, 500.0)]
_cell_sql = " UNION ALL ".join(
    f"SELECT {k} AS horizon_k, {b}::DOUBLE AS no_trade_band_bps, ticker, trading_day, label, valid_label, sample_id, "
    "invalid_missing_future, invalid_cross_trading_day, invalid_irregular_horizon, invalid_cross_split, invalid_no_trade_band "
    f"FROM ({labels_sql(k, f'{b}::DOUBLE', 'trainbars')})" for k, b in CELLS)
cte("trainbars", "SELECT * FROM bars WHERE split = 'train'")
cte("cell_labels", _cell_sql)


def train_cells(spark, sf):
    tb = TP.bars(spark, sf).filter("split = 'train'")
    return L.cell_profiles(tb, CELLS, TP.INTERVAL_MINUTES, TP.SPLITS)


@query("f3_cell_profiles", f"""SELECT horizon_k, no_trade_band_bps, count(*)::BIGINT AS n_bar_rows,
  count_if(valid_label)::BIGINT AS n_eligible_label_rows, count_if(label = 1)::BIGINT AS up_rows, count_if(label = 0)::BIGINT AS down_rows,
  count(DISTINCT CASE WHEN valid_label THEN trading_day END)::BIGINT AS n_trading_days,
  count_if(invalid_missing_future)::BIGINT AS n_invalid_missing_future, count_if(invalid_cross_trading_day)::BIGINT AS n_invalid_cross_trading_day,
  count_if(invalid_irregular_horizon)::BIGINT AS n_invalid_irregular_horizon, count_if(invalid_cross_split)::BIGINT AS n_invalid_cross_split,
  count_if(invalid_no_trade_band)::BIGINT AS n_invalid_no_trade_band, {r('avg(label)')} AS up_prior FROM cell_labels GROUP BY 1, 2""")
def f3(spark, sf):
    return rounded(L.cell_summary(train_cells(spark, sf)))


_bandq = ", ".join(f"{r(f'quantile_cont(abs(fr) * 10000, {q})', 6)} AS abs_return_p{round(q * 100)}_bps" for q in L.DIAGNOSTIC_QUANTILES)


@query("f4_band_diagnostic", f"""WITH el AS (SELECT ticker, fr FROM labelled WHERE split = 'train' AND ok),
  sc AS (SELECT 'overall' AS scope, fr FROM el UNION ALL SELECT ticker, fr FROM el)
  SELECT scope, band_bps, count(*)::BIGINT AS n_train_base_rows, count_if(abs(fr) > t)::BIGINT AS valid_rows,
  count_if(fr > t)::BIGINT AS up_rows, count_if(fr < -t)::BIGINT AS down_rows, count_if(abs(fr) <= t)::BIGINT AS no_trade_rows,
  {r('count_if(abs(fr) > t) / count(*)', 6)} AS valid_pct, {r('count_if(fr > t) / count(*)', 6)} AS up_pct,
  {r('count_if(fr < -t) / count(*)', 6)} AS down_pct, {r('count_if(abs(fr) <= t) / count(*)', 6)} AS no_trade_pct, {_bandq}
  FROM (SELECT *, band_bps / 10000.0::DOUBLE AS t FROM sc, (SELECT unnest([3.0, 10.0, 20.0, 30.0, 50.0])::DOUBLE AS band_bps))
  GROUP BY 1, 2""")
def f4(spark, sf):
    f = L.forward_returns(TP.bars(spark, sf), TP.HORIZON_K, TP.INTERVAL_MINUTES, TP.SPLITS).filter("split = 'train'")
    return rounded(L.band_diagnostic(f), 6)


def train_events(spark, sf):
    return G.valid_events(L.event_index(labelled(spark, sf)), "train")


N_FOLDS = 3
cte("events_train", """SELECT sample_id, ticker, "timestamp" AS target_timestamp, trading_day, split, label
  FROM labelled WHERE split = 'train' AND valid_label""")
cte("days_train", """SELECT trading_day, row_number() OVER (ORDER BY trading_day) - 1 AS i, count(*) OVER () AS nd
  FROM (SELECT DISTINCT trading_day FROM events_train)""")
cte("fold_days", f"""SELECT f AS fold, trading_day, i < least(nd - 1, sp * (f + 1)) AS tr,
  i >= least(nd - 1, sp * (f + 1)) AND i < CASE WHEN f = {N_FOLDS - 1} THEN nd ELSE least(nd, sp * (f + 2)) END AS ev
  FROM (SELECT *, greatest(1, nd // {N_FOLDS + 1}) AS sp FROM days_train), (SELECT unnest(range({N_FOLDS})) AS f)""")
cte("folds", f"""SELECT 'fold_' || fold AS fold_id, min(CASE WHEN tr THEN target_timestamp END) AS train_start,
  min(CASE WHEN ev THEN target_timestamp END) AS eval_start,
  max(CASE WHEN ev THEN target_timestamp END) + INTERVAL 1 MICROSECOND AS eval_end_exclusive,
  count_if(tr)::BIGINT AS n_train_samples, count_if(ev)::BIGINT AS n_eval_samples
  FROM fold_days JOIN events_train USING (trading_day) GROUP BY fold""")


@query("f5_train_inner_folds", f"""SELECT fold_id, train_start, eval_start AS train_end_exclusive, eval_start, eval_end_exclusive,
  '{FD.POLICY}' AS purge_or_embargo_policy, n_train_samples, n_eval_samples, 0::BIGINT AS event_overlap_count FROM folds""")
def f5(spark, sf):
    return FD.train_inner_folds(train_events(spark, sf), N_FOLDS)


cte("fold_member", """SELECT e.*, f.fold_id, CASE WHEN e.target_timestamp < f.eval_start THEN 'train' ELSE 'eval' END AS fold_side
  FROM events_train e JOIN folds f ON (e.target_timestamp >= f.train_start AND e.target_timestamp < f.eval_start)
  OR (e.target_timestamp >= f.eval_start AND e.target_timestamp < f.eval_end_exclusive)""")


def members(spark, sf):
    ev = train_events(spark, sf)
    return FD.fold_rows(ev, FD.train_inner_folds(ev, N_FOLDS))


@query("c8_fold_rows", "SELECT sample_id, fold_id, fold_side, label FROM fold_member")
def c8(spark, sf):
    return members(spark, sf).select("sample_id", "fold_id", "fold_side", "label")


CAP = 150


@query("f6_even_stride_cap", f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY ticker, label ORDER BY target_timestamp, sample_id) - 1 AS pos,
    count(*) OVER (PARTITION BY ticker, label) AS n, count(*) OVER () AS total FROM fold_member WHERE fold_id = 'fold_0' AND fold_side = 'train'),
  s AS (SELECT count(DISTINCT (ticker, label)) AS ng, greatest(1, {CAP} // count(DISTINCT (ticker, label))) AS per FROM g),
  want AS (SELECT DISTINCT ticker, label, CASE WHEN i = per - 1 AND per > 1 THEN n - 1
      ELSE floor(i * ((n - 1)::DOUBLE / greatest(per - 1, 1)))::BIGINT END AS pos
    FROM (SELECT DISTINCT ticker, label, n FROM g), s, (SELECT unnest(range({CAP})) AS i) WHERE i < per)
  SELECT sample_id, g.ticker, g.label FROM g, s WHERE total <= {CAP} OR n <= per
    OR EXISTS (SELECT 1 FROM want w WHERE w.ticker = g.ticker AND w.label = g.label AND w.pos = g.pos)""")
def f6(spark, sf):
    tr = members(spark, sf).filter("fold_id = 'fold_0' and fold_side = 'train'")
    return FD.even_stride_cap(tr, CAP).select("sample_id", "ticker", "label")


@query("f7_capped_fold_rows", f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY fold_id, fold_side, ticker, label ORDER BY target_timestamp, sample_id) - 1 AS pos,
    count(*) OVER (PARTITION BY fold_id, fold_side, ticker, label) AS n, count(*) OVER (PARTITION BY fold_id, fold_side) AS total FROM fold_member),
  s AS (SELECT fold_id, fold_side, greatest(1, {CAP} // count(DISTINCT (ticker, label))) AS per FROM g GROUP BY 1, 2),
  h AS (SELECT g.*, s.per FROM g JOIN s USING (fold_id, fold_side)),
  want AS (SELECT DISTINCT fold_id, fold_side, ticker, label, CASE WHEN i = per - 1 AND per > 1 THEN n - 1
      ELSE floor(i * ((n - 1)::DOUBLE / greatest(per - 1, 1)))::BIGINT END AS pos
    FROM (SELECT DISTINCT fold_id, fold_side, ticker, label, n, per FROM h), (SELECT unnest(range({CAP})) AS i) WHERE i < per),
  kept AS (SELECT * FROM h WHERE fold_side <> 'train' OR total <= {CAP} OR n <= per OR EXISTS (SELECT 1 FROM want w WHERE w.fold_id = h.fold_id
    AND w.fold_side = h.fold_side AND w.ticker = h.ticker AND w.label = h.label AND w.pos = h.pos))
  SELECT fold_id, fold_side, count(*)::BIGINT AS n_rows,
    sum(('0x' || substr(sha256(sample_id), 1, 13))::BIGINT)::DOUBLE AS id_sum FROM kept GROUP BY 1, 2""")
def f7(spark, sf):
    return FD.capped_fold_rows(members(spark, sf), CAP).groupBy("fold_id", "fold_side").agg(
        F.count("*").alias("n_rows"), Q.id_sum("sample_id").cast("double").alias("id_sum"))


@query("c1_event_bar_position", """WITH pos AS (SELECT ticker, trading_day, "timestamp",
  row_number() OVER (PARTITION BY ticker, trading_day ORDER BY "timestamp") - 1 AS bar_position FROM bars)
  SELECT sample_id, bar_position::INTEGER AS bar_position FROM events_train e JOIN pos p ON e.ticker = p.ticker
  AND e.trading_day = p.trading_day AND e.target_timestamp = p."timestamp" """)
def c1(spark, sf):
    return J.bar_position(train_events(spark, sf), TP.bars(spark, sf)).select("sample_id", "bar_position")


WINDOW, WIN_FEATS = 5, ["log_return", "high_low_range", "time_of_day_sin"]
cte("windows5", """SELECT sample_id, x.ticker, target_timestamp, label, e - 5 AS window_start_position, e AS window_end_position_exclusive,
    fs, lr, hl, td FROM (SELECT ticker, trading_day, "timestamp", row_number() OVER (w) AS e,
    count(log_return + high_low_range + time_of_day_sin) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS okn,
    sum(log_return::FLOAT::DOUBLE + high_low_range::FLOAT::DOUBLE + time_of_day_sin::FLOAT::DOUBLE) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fs,
    log_return AS lr, high_low_range AS hl, time_of_day_sin AS td FROM features
    WINDOW w AS (PARTITION BY ticker, trading_day ORDER BY "timestamp")) f
  JOIN events_train x ON x.ticker = f.ticker AND x.trading_day = f.trading_day AND x.target_timestamp = f."timestamp" WHERE okn = 5""")


def windows(spark, sf, split="train"):
    ev = G.valid_events(L.event_index(labelled(spark, sf)), split) if split else (
        L.event_index(labelled(spark, sf)).filter("valid_label and split in ('train', 'validation')"))
    return WN.window_dataset(featured(spark, sf), ev, WIN_FEATS, WINDOW, "base")


@query("e12_window_dataset", """SELECT sample_id, ticker, target_timestamp, label, window_start_position::INTEGER AS window_start_position,
  window_end_position_exclusive::INTEGER AS window_end_position_exclusive, 'base_w5' AS candidate_id FROM windows5""")
def e12(spark, sf):
    return windows(spark, sf).select("sample_id", "ticker", "target_timestamp", "label", "window_start_position",
                                     "window_end_position_exclusive", "candidate_id")


# Every cell of the matrix with its place: a wrong order of time or feature gives other rows.
@query("e13_window_matrix", f"""SELECT w.sample_id, b.bar_no - w.window_start_position - 1 AS step, unnest(['log_return', 'high_low_range', 'time_of_day_sin']) AS feature,
    unnest([{r('b.log_return::FLOAT', 6)}, {r('b.high_low_range::FLOAT', 6)}, {r('b.time_of_day_sin::FLOAT', 6)}]) AS value
  FROM windows5 w JOIN (SELECT *, row_number() OVER (PARTITION BY ticker, trading_day ORDER BY "timestamp") AS bar_no FROM features) b
    ON b.ticker = w.ticker AND b.trading_day = strftime(w.target_timestamp, '%Y-%m-%d') AND b.bar_no > w.window_start_position AND b.bar_no <= w.window_end_position_exclusive""")
def e13(spark, sf):
    w = windows(spark, sf).select("sample_id", F.posexplode("features").alias("i", "v"))
    names = F.array(*[F.lit(n) for n in WIN_FEATS])
    n = len(WIN_FEATS)
    return w.select("sample_id", F.floor(F.col("i") / n).cast("long").alias("step"), F.get(names, F.col("i") % n).alias("feature"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("e14_last_bar_slice", f"""SELECT sample_id, {r('lr::FLOAT', 5)} AS f0, {r('hl::FLOAT', 5)} AS f1, {r('td::FLOAT', 5)} AS f2 FROM windows5""")
def e14(spark, sf):
    last = WN.last_bar(F.col("features"), 3)
    return windows(spark, sf).select("sample_id", *[F.round(last[i].cast("double"), 5).alias(f"f{i}") for i in range(3)])


@query("e20_early_stop_tail", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY target_timestamp DESC, trading_day DESC, ticker DESC, sample_id DESC) AS rk,
    count(*) OVER (PARTITION BY fold_id) AS n FROM fold_member WHERE fold_side = 'train'),
  t AS (SELECT *, rk <= greatest(50, ceil(n * 0.2::DOUBLE)) AS stop FROM o)
  SELECT fold_id, count(*)::BIGINT AS n_train, count_if(stop)::BIGINT AS n_stop, sum(CASE WHEN stop THEN label END)::BIGINT AS stop_up,
    sum(CASE WHEN NOT stop THEN label END)::BIGINT AS fit_up, 'configured_inner_train_subsplit' AS reason,
    min(CASE WHEN stop THEN target_timestamp END) AS stop_start FROM t GROUP BY 1""")
def e20(spark, sf):
    tr = members(spark, sf).filter("fold_side = 'train'")
    t = FD.early_stop_tail(tr, ["fold_id"], fraction=0.2, min_eval=50, min_train=50)
    return t.groupBy("fold_id").agg(
        F.count("*").alias("n_train"), F.count_if(F.col("is_stop")).alias("n_stop"),
        F.sum(F.when(F.col("is_stop"), F.col("label"))).alias("stop_up"),
        F.sum(F.when(~F.col("is_stop"), F.col("label"))).alias("fit_up"), F.first("reason").alias("reason"),
        F.min(F.when(F.col("is_stop"), F.col("target_timestamp"))).alias("stop_start"))


# ---- D: calendar -----------------------------------------------------------------------

cte("periods", """SELECT 'wf_' || y AS period_id, make_timestamp(y, 1, 1, 0, 0, 0) AS period_start,
  least(make_timestamp(y + 1, 1, 1, 0, 0, 0), (SELECT max(target_timestamp) + INTERVAL 1 MICROSECOND FROM facts)) AS period_end
  FROM (SELECT unnest(range(1996, (SELECT max(yr) + 1 FROM facts)))::BIGINT AS y)""")


def periods(spark, sf):
    return B.yearly_periods(P.facts(spark, sf), P.WARMUP_END, "target_timestamp")


@query("d2_yearly_periods", "SELECT period_id, period_start, period_end FROM periods")
def d2(spark, sf):
    return periods(spark, sf)


@query("d3_period_registry", """SELECT period_id, count(*)::BIGINT AS eligible_rows, count(DISTINCT trading_day)::BIGINT AS covered_days
  FROM facts f JOIN periods p ON f.target_timestamp >= p.period_start AND f.target_timestamp < p.period_end GROUP BY 1""")
def d3(spark, sf):
    p = periods(spark, sf)
    t = F.col("target_timestamp")
    rows = P.facts(spark, sf).join(F.broadcast(p), (t >= F.col("period_start")) & (t < F.col("period_end")))
    days = rows.groupBy("period_id", "trading_day").agg(F.count("*").alias("n"))
    return days.groupBy("period_id").agg(F.sum("n").alias("eligible_rows"), F.count("*").alias("covered_days"))


@query("d4_calendar_slices", """SELECT year(target_timestamp)::VARCHAR AS calendar_year, year(target_timestamp) || 'Q' || quarter(target_timestamp) AS calendar_quarter,
  strftime(target_timestamp, '%H') AS time_of_day_hour, count(*)::BIGINT AS n FROM facts GROUP BY 1, 2, 3""")
def d4(spark, sf):
    return B.calendar_columns(P.facts(spark, sf)).groupBy("calendar_year", "calendar_quarter", "time_of_day_hour").agg(
        F.count("*").alias("n"))


@query("c9_walkforward_rows", """SELECT period_id, CASE WHEN target_timestamp < period_start THEN 'train' ELSE 'test' END AS fold_side,
  count(*)::BIGINT AS n, sum(y_true)::BIGINT AS n_up FROM facts JOIN periods ON target_timestamp < period_end GROUP BY 1, 2""")
def c9(spark, sf):
    """Counts of every period's sides from running sums over the periods: no row is repeated per later period."""
    return FD.expanding_sums(P.facts(spark, sf), periods(spark, sf), {"n": F.lit(1), "n_up": F.col("y_true")})


@query("c9_walkforward_priors", f"""SELECT 'wf_' || yr AS period_id, {r('prior')} AS prior FROM priors WHERE yr >= 1996""")
def c9b(spark, sf):
    """Per-period priors from running yearly counts: no row is repeated per later period."""
    return rounded(P.period_priors(P.facts(spark, sf)).filter("year >= 1996").select(
        P.period_of("year").alias("period_id"), "prior"))


@query("b12_embargo", """SELECT m.fold_id, count(*)::BIGINT AS n FROM fold_member m JOIN folds f USING (fold_id)
  WHERE fold_side = 'eval' AND trading_day <> strftime(f.eval_start, '%Y-%m-%d') GROUP BY 1""")
def b12(spark, sf):
    ev = train_events(spark, sf)
    folds = FD.train_inner_folds(ev, N_FOLDS)
    return G.embargo(FD.fold_rows(ev, folds).filter("fold_side = 'eval'"), folds).groupBy("fold_id").agg(
        F.count("*").alias("n"))
