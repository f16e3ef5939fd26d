"""Microstructure queries on the tape's bars.

The tape's walk-forward rows are its valid labels: y_true is the label, y_pred follows the last
log return and the baseline is a keyed coin, so readouts join day cells of the same bars.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confusion as C
from ..functions.scalar import hash01
from ..operators import decide as DE, features as FT, joins as J, labels as L, micro as MI, readouts as RO, slices as SL
from ..sources import predictions as P, tape as TP
from .base import RESUM_SQL, SUMS_SQL, bf1, cte, delta, div, f1, h01, query, r, rounded
from .ingest import POLICY, labelled
from .robust import BOOT_SEED, N_BOOT, SIX, _seed_mean_sql, boot_sql

DAYS, MIN_PAIRS, MIN_SPANS, BAND = 5, 40, 40, 0.5

cte("pairs", """SELECT ticker, trading_day, "timestamp", a, lag(a) OVER (PARTITION BY ticker, trading_day ORDER BY "timestamp") AS b FROM
  (SELECT ticker, trading_day, "timestamp", log_return AS a FROM feat1)""")
cte("pair_stats", """SELECT ticker, trading_day, count(*)::BIGINT AS n, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab, sum(a * a) AS saa, sum(b * b) AS sbb
  FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""")
cte("roll_t", f"""SELECT ticker, trading_day, coalesce(sum(n) OVER w, 0)::BIGINT AS n, sum(sa) OVER w AS sa, sum(sb) OVER w AS sb, sum(sab) OVER w AS sab
  FROM pair_stats WINDOW w AS (PARTITION BY ticker ORDER BY trading_day ROWS BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)""")
cte("roll", f"""SELECT ticker, trading_day, n AS n_pairs, c AS autocov_lag1, CASE WHEN c < 0 THEN sqrt(-c) END AS halfspread,
    CASE WHEN n < {MIN_PAIRS} THEN 'insufficient_history' WHEN c < 0 THEN 'ok' ELSE 'roll_undefined_nonneg_autocov' END AS status
  FROM (SELECT *, CASE WHEN n >= {MIN_PAIRS} THEN (sab - sa * sb / n) / (n - 1) END AS c FROM roll_t)""")
cte("roll_cells", f"""SELECT *, halfspread / {BAND}::DOUBLE AS spread_band_ratio, CASE WHEN status <> 'ok' THEN status WHEN halfspread / {BAND}::DOUBLE <= 0.5 THEN 'ratio_le_0p5'
    WHEN halfspread / {BAND}::DOUBLE <= 1.0 THEN 'ratio_0p5_to_1' WHEN halfspread / {BAND}::DOUBLE <= 2.0 THEN 'ratio_1_to_2' ELSE 'ratio_gt_2' END AS cell FROM roll""")


def roll(spark, sf):
    return MI.roll_halfspread(TP.bars(spark, sf), DAYS, MIN_PAIRS)


def day_cells(spark, sf):
    return MI.spread_partition(roll(spark, sf), BAND)


@query("e15_lag1_pair_stats", f"SELECT ticker, trading_day, n, {', '.join(f'{r(c, 7)} AS {c}' for c in ('sa', 'sb', 'sab', 'saa', 'sbb'))} FROM pair_stats")
def e15(spark, sf):
    return rounded(MI.day_pair_stats(TP.bars(spark, sf)), 7)


@query("e16_trailing_pooling", f"SELECT ticker, trading_day, n, {', '.join(f'{r(f'coalesce({c}, 0)', 7)} AS {c}' for c in ('sa', 'sb', 'sab'))} FROM roll_t")
def e16(spark, sf):
    return rounded(MI.trailing_days(MI.day_pair_stats(TP.bars(spark, sf)), ["n", "sa", "sb", "sab"], DAYS), 7)


@query("n1_roll_halfspread", f"SELECT ticker, trading_day, n_pairs, {r('autocov_lag1', 7)} AS autocov_lag1, {r('halfspread', 7)} AS halfspread, status FROM roll")
def n1(spark, sf):
    return rounded(roll(spark, sf), 7)


cte("cs_s", """SELECT ticker, trading_day, count(*)::BIGINT AS n, sum(hl + phl) AS beta, sum(g) AS gamma FROM (SELECT *, lag(hl) OVER w AS phl,
    CASE WHEN lag(high) OVER w IS NOT NULL AND greatest(high, lag(high) OVER w) / nullif(least(low, lag(low) OVER w), 0) > 0 THEN ln(greatest(high, lag(high) OVER w) / nullif(least(low, lag(low) OVER w), 0)) ** 2 END AS g
    FROM (SELECT *, CASE WHEN high / nullif(low, 0) > 0 THEN ln(high / nullif(low, 0)) ** 2 END AS hl FROM bars) WINDOW w AS (PARTITION BY ticker, trading_day ORDER BY "timestamp"))
  WHERE hl IS NOT NULL AND phl IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2""")
cte("cs", f"""SELECT ticker, trading_day, n AS cs_n_spans, al AS cs_alpha, CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) / 2 END AS cs_halfspread,
    CASE WHEN n >= {MIN_SPANS} THEN 'ok' ELSE 'insufficient_history' END AS cs_status
  FROM (SELECT *, CASE WHEN n >= {MIN_SPANS} THEN (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) END AS al FROM
    (SELECT ticker, trading_day, n, bs / nullif(n, 0) AS b, gs / nullif(n, 0) AS g FROM (SELECT ticker, trading_day, coalesce(sum(n) OVER w, 0)::BIGINT AS n, sum(beta) OVER w AS bs, sum(gamma) OVER w AS gs FROM cs_s
      WINDOW w AS (PARTITION BY ticker ORDER BY trading_day ROWS BETWEEN {DAYS} PRECEDING AND 1 PRECEDING))))""")


def cs(spark, sf):
    return MI.corwin_schultz(TP.bars(spark, sf), DAYS, MIN_SPANS)


@query("n2_corwin_schultz", f"SELECT ticker, trading_day, cs_n_spans, {r('cs_alpha', 7)} AS cs_alpha, {r('cs_halfspread', 7)} AS cs_halfspread, cs_status FROM cs")
def n2(spark, sf):
    return rounded(cs(spark, sf), 7)


@query("c6_spread_merge", f"""SELECT ticker, trading_day, n_pairs, status, cs_n_spans, {r('cs_halfspread', 7)} AS cs_halfspread, coalesce(cs_status, 'insufficient_history') AS cs_status
  FROM roll LEFT JOIN cs USING (ticker, trading_day)""")
def c6(spark, sf):
    m = MI.merge_spreads(roll(spark, sf), cs(spark, sf))
    return rounded(m.select("ticker", "trading_day", "n_pairs", "status", "cs_n_spans", "cs_halfspread", "cs_status"), 7)


@query("n3_spread_partition", f"SELECT ticker, trading_day, {r('spread_band_ratio', 7)} AS spread_band_ratio, cell FROM roll_cells")
def n3(spark, sf):
    return rounded(day_cells(spark, sf).select("ticker", "trading_day", "spread_band_ratio", "cell"), 7)


def tape_scored(spark, sf):
    """Valid labels with a momentum rule and a keyed coin as baseline, for the two seeds."""
    lab = labelled(spark, sf).filter("valid_label").select("ticker", "trading_day", "timestamp", "sample_id", F.col("label").alias("y_true"))
    ft = FT.add_features(TP.bars(spark, sf)).select("ticker", "trading_day", "timestamp", "log_return")
    x = lab.join(ft, ["ticker", "trading_day", "timestamp"]).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in P.SEEDS])))
    follow = F.when(F.coalesce(F.col("log_return"), F.lit(0.0)) > 0, 1).otherwise(0)
    flip = hash01("flip", F.col("seed"), F.col("sample_id")) < 0.1
    return x.withColumns({"y_pred": F.when(flip, 1 - follow).otherwise(follow),
                          "base_pred": F.when(hash01("coin", F.col("seed"), F.col("sample_id")) < 0.5, 1).otherwise(0)})


cte("tape_scored", f"""SELECT l.ticker, l.trading_day, l."timestamp", l.sample_id, l.label AS y_true, s.seed,
    CASE WHEN {h01("'flip|' || s.seed || '|' || l.sample_id")} < 0.1::DOUBLE THEN 1 - fo ELSE fo END AS y_pred,
    CASE WHEN {h01("'coin|' || s.seed || '|' || l.sample_id")} < 0.5::DOUBLE THEN 1 ELSE 0 END AS base_pred
  FROM (SELECT l.*, CASE WHEN coalesce(f.log_return, 0) > 0 THEN 1 ELSE 0 END AS fo FROM labelled l JOIN features f USING (ticker, trading_day, "timestamp") WHERE l.valid_label) l, seeds s""")
cte("tape_terciles", """SELECT ticker, trading_day, CASE least(3, greatest(1, ceil(rk::DOUBLE / nd::DOUBLE * 3)))::INTEGER WHEN 1 THEN 'low' WHEN 2 THEN 'mid' ELSE 'high' END AS activity_tercile
  FROM (SELECT ticker, trading_day, row_number() OVER (PARTITION BY ticker ORDER BY nr, trading_day) AS rk, count(*) OVER (PARTITION BY ticker) AS nd
    FROM (SELECT ticker, trading_day, count(*) AS nr FROM tape_scored GROUP BY 1, 2))""")
cte("tape_blocks", f"""SELECT s.seed, s.ticker, s.trading_day, coalesce(c.cell, 'insufficient_history') AS own, t.activity_tercile, {SUMS_SQL} FROM tape_scored s
  JOIN tape_terciles t USING (ticker, trading_day) LEFT JOIN roll_cells c USING (ticker, trading_day) GROUP BY 1, 2, 3, 4, 5""")


def _memb(where: str) -> str:
    return f"""SELECT *, unnest(list_filter(['all', own, CASE WHEN own IN ('ratio_le_0p5', 'ratio_0p5_to_1') THEN 'ratio_le_1' WHEN own IN ('ratio_1_to_2', 'ratio_gt_2') THEN 'ratio_gt_1' END],
      lambda x: x IS NOT NULL)) AS cell FROM tape_blocks WHERE {where}"""


cte("n4_long", _memb("true"))
boot_sql("n4", "n4_long", ["cell", "seed"], N_BOOT, SIX)
cte("n12_long", _memb("activity_tercile = 'low'"))
boot_sql("n12", "n12_long", ["cell", "seed"], N_BOOT, SIX)
_cells = ", ".join(f"'{c}'" for c in MI.ALL_CELLS)


def _readout_sql(pre: str) -> str:
    per = f"""SELECT g.cell, g.seed::VARCHAR AS seed, coalesce(a.n, 0)::BIGINT AS n_rows, coalesce(a.nd, 0)::BIGINT AS n_days, {div('a.p', 'a.n')} AS up_rate, {f1('a.n', 'a.p', 'a.pp', 'a.tp')} AS macro_f1,
      {bf1('a.n', 'a.p', 'a.bp', 'a.btp')} AS dummy_macro_f1, {f1('a.n', 'a.p', 'a.pp', 'a.tp')} - {bf1('a.n', 'a.p', 'a.bp', 'a.btp')} AS delta_vs_dummy, b.l AS boot_delta_lcb, b.u AS boot_delta_ucb,
      coalesce(a.n, 0) < 200 AS thin_cell, CASE WHEN coalesce(a.n, 0) = 0 THEN 'empty_cell' ELSE '' END AS note
      FROM (SELECT unnest([{_cells}]) AS cell, seed FROM seeds) g LEFT JOIN (SELECT cell, seed, count(*) AS nd, {RESUM_SQL} FROM {pre}_long GROUP BY 1, 2) a ON a.cell = g.cell AND a.seed = g.seed
      LEFT JOIN (SELECT cell, seed, quantile_cont(d, 0.025) AS l, quantile_cont(d, 0.975) AS u FROM (SELECT cell, seed, {delta()} AS d FROM {pre}_draws) GROUP BY 1, 2) b ON b.cell = g.cell AND b.seed = g.seed"""
    cte(f"{pre}_per", per)
    return f"""SELECT *, coalesce(macro_f1 < 0.5, false) AS below_random_prior FROM (SELECT * FROM {pre}_per UNION ALL SELECT cell, 'seed_mean', sum(n_rows)::BIGINT, max(n_days)::BIGINT, avg(up_rate), avg(macro_f1),
      avg(dummy_macro_f1), avg(delta_vs_dummy), NULL, NULL, bool_or(thin_cell), '' FROM {pre}_per GROUP BY 1)"""


cte("n4_out", _readout_sql("n4"))
cte("n12_out", _readout_sql("n12"))
_N4 = ["up_rate", "macro_f1", "dummy_macro_f1", "delta_vs_dummy", "boot_delta_lcb", "boot_delta_ucb"]


def tape_blocks(spark, sf):
    return RO.block_cells(tape_scored(spark, sf), ["seed"])


@query("n4_partition_readout", f"SELECT cell, seed, n_rows, n_days, {', '.join(f'{r(c)} AS {c}' for c in _N4)}, thin_cell, note, below_random_prior FROM n4_out")
def n4(spark, sf):
    return rounded(MI.partition_readout(tape_blocks(spark, sf), day_cells(spark, sf), N_BOOT, BOOT_SEED))


@query("n5_spread_activity_occupancy", """SELECT own AS cell, activity_tercile, sum(n)::BIGINT AS n_rows, count(DISTINCT (ticker, trading_day))::BIGINT AS n_days FROM tape_blocks GROUP BY 1, 2""")
def n5(spark, sf):
    b = tape_blocks(spark, sf)
    t = SL.with_terciles(b).select("ticker", "trading_day", "activity_tercile").distinct()
    return MI.occupancy(b, day_cells(spark, sf), t)


def tape_terciles(spark, sf):
    return SL.activity_terciles(tape_scored(spark, sf))


@query("n6_autocov_by_tercile", f"""SELECT activity_tercile, sum(n)::BIGINT AS n_pairs, {r('(sum(sab) - sum(sa) * sum(sb) / sum(n)) / (sum(n) - 1)', 7)} AS autocov_lag1,
  {r('(sum(sab) - sum(sa) * sum(sb) / sum(n)) / sqrt((sum(saa) - sum(sa) * sum(sa) / sum(n)) * (sum(sbb) - sum(sb) * sum(sb) / sum(n)))', 7)} AS autocorr_lag1
  FROM (SELECT p.*, unnest(['all', t.activity_tercile]) AS activity_tercile FROM pair_stats p JOIN tape_terciles t USING (ticker, trading_day)) GROUP BY 1""")
def n6(spark, sf):
    return rounded(MI.autocov_by_tercile(TP.bars(spark, sf), tape_terciles(spark, sf)), 7)


@query("c7_stats_tercile_join", """SELECT t.activity_tercile, count(*)::BIGINT AS n_days, sum(p.n)::BIGINT AS n_pairs FROM pair_stats p JOIN tape_terciles t USING (ticker, trading_day) GROUP BY 1""")
def c7(spark, sf):
    j = MI.day_pair_stats(TP.bars(spark, sf)).join(tape_terciles(spark, sf), ["ticker", "trading_day"])
    return j.groupBy("activity_tercile").agg(F.count("*").alias("n_days"), F.sum("n").alias("n_pairs"))


def low_readout(spark, sf):
    b = SL.with_terciles(tape_blocks(spark, sf)).filter("activity_tercile = 'low'").drop("activity_tercile")
    return MI.partition_readout(b, day_cells(spark, sf), N_BOOT, BOOT_SEED)


VERDICT_MIN = 50


@query("p12_halfspread_verdict", f"""WITH a AS (SELECT * FROM n12_out WHERE seed <> 'seed_mean'), m AS (SELECT * FROM n12_out WHERE seed = 'seed_mean'),
  pick AS (SELECT CASE WHEN bool_and(n_rows >= {VERDICT_MIN}) THEN 'ratio_le_0p5' ELSE 'ratio_le_1' END AS low_anchor FROM a WHERE cell = 'ratio_le_0p5'),
  lo AS (SELECT a.* FROM a, pick WHERE a.cell = pick.low_anchor), hi AS (SELECT * FROM a WHERE cell = 'ratio_gt_1'),
  c AS (SELECT (SELECT low_anchor FROM pick) AS low_anchor_used, (SELECT bool_and(n_rows >= {VERDICT_MIN}) FROM lo) AND (SELECT bool_and(n_rows >= {VERDICT_MIN}) FROM hi) AS occ,
    (SELECT bool_and(delta_vs_dummy <= 0 OR (boot_delta_lcb <= 0 AND boot_delta_ucb >= 0)) FROM lo) AS low_null, (SELECT bool_and(delta_vs_dummy > 0 AND boot_delta_lcb > 0) FROM lo) AS low_pos,
    (SELECT bool_and(delta_vs_dummy > 0 AND boot_delta_lcb > 0) FROM hi) AS high_pos, (SELECT bool_and(delta_vs_dummy > 0) OR bool_and(delta_vs_dummy <= 0) FROM lo) AS agree,
    (SELECT avg(delta_vs_dummy) FROM lo) AS low_mean, (SELECT max(delta_vs_dummy) FROM m WHERE cell = 'all') AS all_delta),
  f AS (SELECT delta_vs_dummy AS d, lag(delta_vs_dummy) OVER (ORDER BY list_position(['ratio_le_0p5', 'ratio_0p5_to_1', 'ratio_1_to_2', 'ratio_gt_2'], cell)) AS q FROM m
    WHERE cell IN ('ratio_le_0p5', 'ratio_0p5_to_1', 'ratio_1_to_2', 'ratio_gt_2') AND n_rows >= 400 AND delta_vs_dummy IS NOT NULL),
  mono AS (SELECT count(*) >= 3 AND count_if(d < q) <= 1 AS mono FROM f)
  SELECT low_anchor_used, coalesce(occ, false) AS anchor_occupancy_ok, mono AS monotone_ok, CASE WHEN NOT coalesce(occ, false) THEN 'inconclusive' WHEN NOT agree THEN 'inconclusive'
    WHEN low_null AND high_pos AND mono THEN 'consistent_with_bounce_domination' WHEN low_pos AND all_delta > 0 AND low_mean >= 0.5 * all_delta THEN 'not_explainable_by_bounce_alone' ELSE 'inconclusive' END AS verdict,
    CASE WHEN NOT coalesce(occ, false) THEN 'anchor_occupancy_below_verdict_min_rows' WHEN NOT agree THEN 'per_seed_sign_disagreement_on_low_anchor'
    WHEN low_null AND high_pos AND mono THEN 'low_anchor_null_high_anchor_positive_monotone' WHEN low_pos AND all_delta > 0 AND low_mean >= 0.5 * all_delta THEN 'low_anchor_positive_at_comparable_size'
    ELSE 'pattern_matches_neither_predeclared_outcome' END AS reason FROM c, mono""")
def p12(spark, sf):
    return DE.halfspread_verdict(low_readout(spark, sf), VERDICT_MIN)
