"""Queries over prediction dumps: joins, baselines, metrics, calibration and selective risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confusion as C
from ..functions.scalar import ratio
from ..functions.student_t import lcb_agg
from ..operators import (baselines as BL, calibration as CAL, joins as J, ranks as R, readouts as RO,
                         selective as SEL, slices as SL)
from ..session import materialise
from ..sources import predictions as P
from .base import (RESUM_SQL, SUMS_SQL, _scored, bf1, cf1, cte, delta, div, f1, lcb, query, r, rounded)

ALL = list(P.FAMILIES)
KEYS = ["model_family", "seed", "period_id"]


def cells(spark, sf, families=None, keys=(*KEYS, *RO.BLOCK)):
    """The seven sums per ``keys``: a readout that needs no blocks names fewer, and fewer groups are made."""
    return P.counted(spark, sf, list(keys), families)


def stored(spark, sf, families=None, *columns):
    """The dump as a stored table: queries that sort or scan it several times read this."""
    cols = columns or ("seed", "ticker", "trading_day", "target_timestamp", "sample_id", "y_true", "y_pred", "base_pred", "p_up")
    return materialise(P.scored(spark, sf, families).select(*cols), "dump")


ACC = div("n - p - pp + 2*tp", "n")
BAL = (f"CASE WHEN p = 0 THEN {div('n-p-pp+tp', 'n-p')} WHEN p = n THEN {div('tp', 'p')} "
       f"ELSE ({div('tp', 'p')} + {div('n-p-pp+tp', 'n-p')}) / 2 END")
MCC = ("CASE WHEN p = 0 OR p = n THEN NULL WHEN pp = 0 OR pp = n THEN 0 ELSE (n::DOUBLE*tp - p::DOUBLE*pp) "
       "/ (sqrt(p::DOUBLE*(n-p)) * sqrt(pp::DOUBLE*(n-pp))) END")


# ---- joins -----------------------------------------------------------------------------

@query("e19_activity_terciles", "SELECT ticker, trading_day, activity_tercile FROM day_terciles")
def e19(spark, sf):
    return SL.activity_terciles(P.scored(spark, sf))


@query("c2_attach_day_column", """SELECT activity_tercile, seed, count(*)::BIGINT AS n, sum(y_true)::BIGINT AS n_up
  FROM scored_one JOIN day_terciles USING (ticker, trading_day) GROUP BY 1, 2""")
def c2(spark, sf):
    rows = P.scored(spark, sf)
    d = J.attach_day_column(rows, SL.activity_terciles(rows), "activity_tercile")
    return d.groupBy("activity_tercile", "seed").agg(F.count("*").alias("n"), F.sum("y_true").alias("n_up"))


@query("c3_align_baseline", """SELECT seed, period_id, count(*)::BIGINT AS n, sum(y_pred)::BIGINT AS n_pred_up,
  sum(base_pred)::BIGINT AS n_base_up, sum((y_pred = base_pred)::INTEGER)::BIGINT AS n_agree FROM scored_one GROUP BY 1, 2""")
def c3(spark, sf):
    """The two dumps as separate tables, joined one to one on (seed, sample_id)."""
    cand = P.scored(spark, sf).drop("base_pred", "prior")
    j = J.align_baseline(cand, P.baseline_dump(spark, sf), ["seed", "sample_id"])
    return j.groupBy("seed", "period_id").agg(
        F.count("*").alias("n"), F.sum("y_pred").alias("n_pred_up"), F.sum("base_pred").alias("n_base_up"),
        F.count_if(F.col("y_pred") == F.col("base_pred")).alias("n_agree"))


# Planted defects of a baseline dump: by the last digit of the sample, dropped, doubled or relabelled rows.
@query("c3_alignment_report", """WITH b AS (SELECT 'as_is' AS variant, seed, sample_id, y_true FROM scored_one
    UNION ALL SELECT 'planted', seed, sample_id, CASE WHEN right(sample_id, 1) = '5' THEN 1 - y_true ELSE y_true END FROM scored_one WHERE right(sample_id, 1) <> '7'
    UNION ALL SELECT 'planted', seed, sample_id, y_true FROM scored_one WHERE right(sample_id, 1) = '3'),
  k AS (SELECT variant, seed, sample_id, count(*) AS n, min(y_true) AS y FROM b GROUP BY 1, 2, 3)
  SELECT v.variant, count(*)::BIGINT AS candidate_rows, count_if(k.n IS NULL)::BIGINT AS missing_rows, count_if(k.n > 1)::BIGINT AS repeated_rows,
    count_if(k.n = 1 AND k.y <> c.y_true)::BIGINT AS label_mismatches, count_if(k.n = 1 AND k.y = c.y_true)::BIGINT AS aligned_rows
  FROM scored_one c, (SELECT unnest(['as_is', 'planted']) AS variant) v LEFT JOIN k ON k.variant = v.variant AND k.seed = c.seed AND k.sample_id = c.sample_id GROUP BY 1""")
def c3r(spark, sf):
    cand, base = P.scored(spark, sf).drop("base_pred", "prior"), P.baseline_dump(spark, sf)
    end = F.right("sample_id", F.lit(1))
    bad = base.filter(end != "7").withColumn("y_true", F.when(end == "5", 1 - F.col("y_true")).otherwise(F.col("y_true"))).unionByName(base.filter(end == "3"))
    on, out = ["seed", "sample_id"], None
    for name, b in (("as_is", base), ("planted", bad)):
        row = J.alignment_report(cand, b, on).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("c5_tercile_carry", """SELECT b.seed, t.activity_tercile, count(*)::BIGINT AS n, sum(b.base_pred)::BIGINT AS n_base_up
  FROM scored_one b JOIN day_terciles t USING (ticker, trading_day) GROUP BY 1, 2""")
def c5(spark, sf):
    base = P.baseline_dump(spark, sf)
    terc = SL.activity_terciles(P.scored(spark, sf))
    d = J.attach_day_column(base, terc, "activity_tercile")
    return d.groupBy("seed", "activity_tercile").agg(F.count("*").alias("n"), F.sum("y_pred").alias("n_base_up"))


def ledger(spark, sf):
    return RO.ledger_of_counts(P.counted(spark, sf, RO.LEDGER_KEYS, ALL))


cte("ledger", f"""SELECT candidate_id, model_family, hpo_profile_id, fold_id, seed, n::BIGINT AS n_rows,
    'completed' AS fit_status,
    {f1()} AS macro_f1, {BAL} AS balanced_accuracy, {MCC} AS mcc, {bf1()} AS dummy_macro_f1,
    CASE WHEN prior > 0.5 THEN {cf1(1)} ELSE {cf1(0)} END AS majority_macro_f1, {delta()} AS delta_vs_dummy,
    {f1()} - CASE WHEN prior > 0.5 THEN {cf1(1)} ELSE {cf1(0)} END AS delta_vs_majority, positive_ticker_count
  FROM (SELECT candidate_id, model_family, hpo_profile_id, fold_id, seed, max(prior) AS prior, {RESUM_SQL},
      count_if({delta()} > 0)::BIGINT AS positive_ticker_count
    FROM (SELECT candidate_id, model_family, hpo_profile_id, period_id AS fold_id, seed, ticker, max(prior) AS prior, {SUMS_SQL}
      FROM scored_all GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5)""")


@query("g14_trial_ledger", f"""SELECT candidate_id, model_family, hpo_profile_id, fold_id, seed, fit_status, n_rows, {r('macro_f1')} AS macro_f1,
  {r('balanced_accuracy')} AS balanced_accuracy, {r('mcc')} AS mcc, {r('dummy_macro_f1')} AS dummy_macro_f1, {r('majority_macro_f1')} AS majority_macro_f1,
  {r('delta_vs_dummy')} AS delta_vs_dummy, {r('delta_vs_majority')} AS delta_vs_majority, positive_ticker_count FROM ledger""")
def g14_ledger(spark, sf):
    return rounded(ledger(spark, sf))


@query("c10_baseline_lookup", f"""SELECT candidate_id, model_family, hpo_profile_id, fold_id, seed, {r('macro_f1')} AS macro_f1,
  {r('dummy_macro_f1')} AS macro_f1_stratified_dummy_train_prior, {r('majority_macro_f1')} AS macro_f1_majority_train_prior FROM ledger""")
def c10(spark, sf):
    led = ledger(spark, sf)
    keys = ["candidate_id", "model_family", "hpo_profile_id", "fold_id", "seed"]
    base = led.select(*keys, F.explode(F.create_map(
        F.lit("stratified_dummy_train_prior"), F.col("dummy_macro_f1"),
        F.lit("majority_train_prior"), F.col("majority_macro_f1"))).alias("baseline_id", "macro_f1"))
    return rounded(J.baseline_lookup(led.select(*keys, "macro_f1"), base, keys))


@query("b14_pending_units", """SELECT candidate_id, model_family, hpo_profile_id, fold_id, seed FROM ledger WHERE seed = 202 AND fold_id IN ('wf_1996', 'wf_1997')""")
def b14(spark, sf):
    """Units to run again from a ledger in which one seed failed in one period and is absent from another."""
    from ..operators.guards import pending_units
    led = ledger(spark, sf)
    keys = ["candidate_id", "model_family", "hpo_profile_id", "fold_id", "seed"]
    late = F.col("seed") == 202
    broken = led.filter(~(late & (F.col("fold_id") == "wf_1997"))).withColumn("fit_status", F.when(late & (F.col("fold_id") == "wf_1996"), "failed").otherwise(F.col("fit_status")))
    return pending_units(led.select(*keys), broken, keys)


@query("c11_overlap_count", """SELECT count(*)::BIGINT AS n_overlap FROM facts WHERE target_timestamp < TIMESTAMP '1997-01-01'
  AND target_timestamp >= TIMESTAMP '1996-01-01'""")
def c11(spark, sf):
    """Samples two overlapping date ranges share (train to 1997, evaluation from 1996)."""
    f = P.facts(spark, sf)
    t = F.col("target_timestamp")
    return J.overlap_count(f.filter(t < F.lit("1997-01-01").cast("timestamp_ntz")),
                           f.filter(t >= F.lit("1996-01-01").cast("timestamp_ntz")), "sample_id")


@query("c12_complement", f"""WITH t AS (SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1),
  g AS (SELECT seed, period_id, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)
  SELECT g.seed, g.period_id, (t.n - g.n)::BIGINT AS n_rest, {r(f1('t.n-g.n', 't.p-g.p', 't.pp-g.pp', 't.tp-g.tp'))} AS rest_macro_f1 FROM g JOIN t USING (seed)""")
def c12(spark, sf):
    rest = SL.complement(cells(spark, sf), ["seed"], ["period_id"])
    return rounded(rest.select("seed", "period_id", F.col("n").alias("n_rest"), C.macro_f1().alias("rest_macro_f1")))


# ---- baselines -------------------------------------------------------------------------

@query("g1_stratified_dummy", f"""SELECT seed, period_id, count(*)::BIGINT AS n, sum(base_pred)::BIGINT AS n_up, {r('max(prior)')} AS prior
  FROM scored_one GROUP BY 1, 2""")
def g1(spark, sf):
    x = P.scored(spark, sf).withColumn("d", BL.stratified_dummy(F.col("prior"), F.col("seed"), F.col("sample_id")))
    return rounded(x.groupBy("seed", "period_id").agg(F.count("*").alias("n"), F.sum("d").alias("n_up"), F.max("prior").alias("prior")))


@query("g2_majority", """SELECT period_id, max(CASE WHEN prior > 0.5 THEN 1 ELSE 0 END)::INTEGER AS majority_class, count(*)::BIGINT AS n
  FROM scored_one GROUP BY 1""")
def g2(spark, sf):
    x = P.scored(spark, sf).withColumn("m", BL.majority(F.col("prior")))
    return x.groupBy("period_id").agg(F.max("m").alias("majority_class"), F.count("*").alias("n"))


cte("registry", """SELECT s.*, b.baseline_id, CASE b.baseline_id WHEN 'stratified_dummy_train_prior' THEN base_pred
    WHEN 'majority_train_prior' THEN (CASE WHEN prior > 0.5 THEN 1 ELSE 0 END) WHEN 'constant_up' THEN 1 ELSE 0 END AS bpred
  FROM scored_one s, (SELECT unnest(['stratified_dummy_train_prior', 'majority_train_prior', 'constant_up', 'constant_down']) AS baseline_id) b""")


@query("g3_baseline_registry", f"""SELECT seed, period_id, baseline_id, n, {r(f1())} AS macro_f1, {r(BAL)} AS balanced_accuracy, {r(ACC)} AS accuracy, {r(MCC)} AS mcc
  FROM (SELECT seed, period_id, baseline_id, count(*)::BIGINT AS n, sum(y_true) AS p, sum(bpred) AS pp, sum(y_true * bpred) AS tp FROM registry GROUP BY 1, 2, 3)""")
def g3(spark, sf):
    return rounded(BL.score_registry(P.scored(spark, sf), ["seed", "period_id"]))


@query("g4_period_baseline_summary", f"""SELECT period_id, {r('avg(f)')} AS mean_dummy_macro_f1, count(*)::BIGINT AS n_seeds
  FROM (SELECT period_id, seed, {bf1()} AS f FROM (SELECT period_id, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)) GROUP BY 1""")
def g4(spark, sf):
    per = RO.deltas(cells(spark, sf), ["period_id", "seed"])
    return rounded(per.groupBy("period_id").agg(F.avg("dummy_macro_f1").alias("mean_dummy_macro_f1"), F.count("*").alias("n_seeds")))


# The second dump has one seed's baseline flipped on one ticker.
cte("replayed", f"""SELECT 'as_is' AS variant, seed, ticker, y_true, y_pred, base_pred, base_pred AS again FROM scored_one
  UNION ALL SELECT 'planted', seed, ticker, y_true, y_pred, base_pred, CASE WHEN seed = 202 AND ticker = 'T1' THEN 1 - base_pred ELSE base_pred END FROM scored_one""")


def figure_sums(rows, *more):
    """Confusion sums per seed and ticker."""
    return rows.groupBy(*more, "seed", "ticker").agg(*C.row_sums())


@query("g5_dummy_replay_gate", f"""WITH s AS (SELECT variant, seed, ticker, count(*) AS n, sum(y_true) AS p, sum(y_pred) AS pp, sum(y_true * y_pred) AS tp, sum(base_pred) AS bp, sum(y_true * base_pred) AS btp,
    sum(again) AS ap, sum(y_true * again) AS atp FROM replayed GROUP BY 1, 2, 3),
  t AS (SELECT variant, seed, sum(n) AS n, sum(p) AS p, sum(bp) AS bp, sum(btp) AS btp, sum(ap) AS ap, sum(atp) AS atp FROM s GROUP BY 1, 2),
  f AS (SELECT variant, seed, ticker AS figure, {f1()} - {f1('n', 'p', 'bp', 'btp')} AS a, {f1()} - {f1('n', 'p', 'ap', 'atp')} AS b FROM s
    UNION ALL SELECT variant, seed, 'macro_f1', {f1('n', 'p', 'bp', 'btp')}, {f1('n', 'p', 'ap', 'atp')} FROM t
    UNION ALL SELECT variant, seed, 'accuracy', (n - p - bp + 2 * btp)::DOUBLE / n, (n - p - ap + 2 * atp)::DOUBLE / n FROM t
    UNION ALL SELECT variant, seed, 'mcc', (n::DOUBLE * btp - p::DOUBLE * bp) / (sqrt(p::DOUBLE * (n - p)) * sqrt(bp::DOUBLE * (n - bp))), (n::DOUBLE * atp - p::DOUBLE * ap) / (sqrt(p::DOUBLE * (n - p)) * sqrt(ap::DOUBLE * (n - ap))) FROM t)
  SELECT variant, seed, count(*)::BIGINT AS n_figures, count_if(abs(a - b) <= 1e-9)::BIGINT AS n_equal,
    CASE WHEN min(min(CASE WHEN abs(a - b) <= 1e-9 THEN 1 ELSE 0 END)) OVER (PARTITION BY variant) = 1 THEN 'verified_identical' ELSE 'mismatch_deltas_not_computed' END AS recon_status FROM f GROUP BY 1, 2""")
def g5(spark, sf):
    """Figures of a re-drawn dummy against those of a dump joined back by sample: as stored, and with flipped rows."""
    rows = P.scored(spark, sf)
    replay = BL.replay_figures(materialise(figure_sums(rows), "replay-sums"))
    cand, base = rows.drop("base_pred"), P.baseline_dump(spark, sf)
    # Both dumps ride on one join; figures need sums per seed and ticker only.
    flip = F.when((F.col("seed") == 202) & (F.col("ticker") == "T1"), 1 - F.col("y_pred")).otherwise(F.col("y_pred"))
    dump = J.align_baselines(cand, base.select("seed", "sample_id", "y_true", F.col("y_pred").alias("as_is"), flip.alias("planted")), ["seed", "sample_id"], ["as_is", "planted"])
    sums = materialise(figure_sums(dump, "variant"), "dump-sums")
    out = None
    for name in ("as_is", "planted"):
        rows = BL.replay_gate(replay, BL.replay_figures(sums.filter(F.col("variant") == name).drop("variant"))).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- H: metrics ------------------------------------------------------------------------

@query("h1_macro_f1", f"""SELECT seed, ticker, n AS n_rows, {r(f1())} AS macro_f1 FROM (SELECT seed, ticker, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)""")
def h1(spark, sf):
    g = P.scored(spark, sf).groupBy("seed", "ticker").agg(*C.row_sums(base=None))
    return rounded(g.select("seed", "ticker", F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1")))


AUC_SQL = """SELECT model_family, seed, (sum(CASE WHEN y_true = 1 THEN ar END) - sum(y_true)::DOUBLE * (sum(y_true) + 1) / 2)
    / (sum(y_true)::DOUBLE * (count(*) - sum(y_true))) AS roc_auc FROM (SELECT *,
    rank() OVER (PARTITION BY model_family, seed ORDER BY p_up) + (count(*) OVER (PARTITION BY model_family, seed, p_up) - 1) / 2.0::DOUBLE AS ar
    FROM scored_all) GROUP BY 1, 2"""
cte("auc", AUC_SQL)


@query("h2_score_classifier", f"""SELECT model_family, seed, n AS n_rows, {r(f1())} AS macro_f1, {r(BAL)} AS balanced_accuracy, {r(ACC)} AS accuracy,
  {r(MCC)} AS mcc, {r('roc_auc')} AS roc_auc FROM (SELECT model_family, seed, {RESUM_SQL} FROM cells_all GROUP BY 1, 2) JOIN auc USING (model_family, seed)""")
def h2(spark, sf):
    rows = stored(spark, sf, ALL, "model_family", "seed", "y_true", "y_pred", "base_pred", "p_up")
    m = RO.metrics(rows.groupBy("model_family", "seed").agg(*C.row_sums()), ["model_family", "seed"])
    return rounded(m.join(R.roc_auc(rows, ["model_family", "seed"]), ["model_family", "seed"]))


@query("h3_roc_auc", f"""SELECT model_family, seed, {r('roc_auc')} AS roc_auc FROM auc""")
def h3(spark, sf):
    return rounded(R.roc_auc(P.scored(spark, sf, ALL), ["model_family", "seed"]))


@query("h3_roc_auc_tied_scores", f"""WITH s AS (SELECT seed, ticker, y_true, round(p_up, 1) AS s FROM scored_one), k AS (SELECT *,
    rank() OVER (PARTITION BY seed, ticker ORDER BY s) + (count(*) OVER (PARTITION BY seed, ticker, s) - 1) / 2.0::DOUBLE AS ar FROM s)
  SELECT seed, ticker, {r('(sum(CASE WHEN y_true = 1 THEN ar END) - sum(y_true)::DOUBLE * (sum(y_true) + 1) / 2) / (sum(y_true)::DOUBLE * (count(*) - sum(y_true)))')} AS roc_auc
  FROM k GROUP BY 1, 2""")
def h3b(spark, sf):
    rows = P.scored(spark, sf).withColumn("p_up", F.round("p_up", 1))
    return rounded(R.roc_auc(rows, ["seed", "ticker"]))


@query("h4_per_class_metrics", f"""SELECT seed, period_id, {r(f"coalesce({div('tp','pp')},0)")} AS precision_up, {r(f"coalesce({div('tp','p')},0)")} AS recall_up,
  {r(f"coalesce({div('2*tp','p+pp')},0)")} AS f1_up, p AS support_up, {r(f"coalesce({div('n-p-pp+tp','n-pp')},0)")} AS precision_down,
  {r(f"coalesce({div('n-p-pp+tp','n-p')},0)")} AS recall_down, {r(f"coalesce({div('2*(n-p-pp+tp)','2*n-p-pp')},0)")} AS f1_down, (n - p) AS support_down
  FROM (SELECT seed, period_id, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)""")
def h4(spark, sf):
    return rounded(RO.per_class(cells(spark, sf), ["seed", "period_id"]))


@query("h5_classification_metrics", f"""SELECT seed, period_id, n AS n_rows, {r(f1())} AS macro_f1, {r(BAL)} AS balanced_accuracy, {r(ACC)} AS accuracy
  FROM (SELECT seed, period_id, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)""")
def h5(spark, sf):
    return rounded(RO.metrics(cells(spark, sf), ["seed", "period_id"]).drop("mcc"))


@query("h6_ticker_delta", f"""WITH d AS (SELECT model_family, seed, ticker, {delta()} AS d FROM (SELECT model_family, seed, ticker, {RESUM_SQL} FROM cells_all GROUP BY 1, 2, 3))
  SELECT model_family, seed, ticker, {r('d')} AS delta_vs_dummy, count_if(d > 0) OVER (PARTITION BY model_family, seed)::BIGINT AS positive_ticker_count FROM d""")
def h6(spark, sf):
    d = RO.deltas(cells(spark, sf, ALL), ["model_family", "seed", "ticker"]).select("model_family", "seed", "ticker", "delta_vs_dummy")
    return rounded(d.join(RO.positive_counts(d, ["model_family", "seed"]), ["model_family", "seed"]))


cte("block_delta", f"""SELECT model_family, seed, ticker, trading_day, {delta()} AS d FROM
  (SELECT model_family, seed, ticker, trading_day, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3, 4)""")


@query("h7_block_delta", f"""SELECT seed, ticker, trading_day, {r('d')} AS delta_vs_dummy FROM block_delta""")
def h7(spark, sf):
    return rounded(RO.deltas(cells(spark, sf), ["seed", "ticker", "trading_day"]).select("seed", "ticker", "trading_day", "delta_vs_dummy"))


@query("h8_per_ticker_readout", f"""WITH x AS (SELECT seed, ticker, {RESUM_SQL}, (SELECT CASE WHEN avg(y_true) > 0.5 THEN 1 ELSE 0 END FROM facts WHERE yr < 1996) AS maj FROM cells_one GROUP BY 1, 2)
  SELECT seed, ticker, n AS n_rows, p AS support_up, n - p AS support_down, {r(f1())} AS macro_f1, {r(BAL)} AS balanced_accuracy, {r(ACC)} AS accuracy,
  {r(delta())} AS delta_vs_dummy, {r(f"{f1()} - CASE WHEN maj = 1 THEN {cf1(1)} ELSE {cf1(0)} END")} AS delta_vs_majority FROM x""")
def h8(spark, sf):
    g = cells(spark, sf).groupBy("seed", "ticker").agg(*C.resum())
    maj = SL.majority_class(spark, sf)
    g = g.crossJoin(F.broadcast(maj))  # one row
    return rounded(g.select(
        "seed", "ticker", F.col("n").alias("n_rows"), F.col("p").alias("support_up"), (F.col("n") - F.col("p")).alias("support_down"),
        C.macro_f1().alias("macro_f1"), C.balanced_accuracy().alias("balanced_accuracy"), C.accuracy().alias("accuracy"),
        C.delta_f1().alias("delta_vs_dummy"), (C.macro_f1() - C.constant_f1(F.col("majority_class"))).alias("delta_vs_majority")))


@query("h9_delta_vs_constant", f"""SELECT seed, period_id, {r(f'{f1()} - {cf1(1)}')} AS delta_vs_constant_up, {r(f'{f1()} - {cf1(0)}')} AS delta_vs_constant_down
  FROM (SELECT seed, period_id, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)""")
def h9(spark, sf):
    g = cells(spark, sf).groupBy("seed", "period_id").agg(*C.resum())
    return rounded(g.select("seed", "period_id", (C.macro_f1() - C.constant_f1(1)).alias("delta_vs_constant_up"),
                            (C.macro_f1() - C.constant_f1(0)).alias("delta_vs_constant_down")))


cte("unit_delta", f"""SELECT model_family, period_id, seed, {f1()} AS f, {bf1()} AS b, {delta()} AS d FROM
  (SELECT model_family, period_id, seed, {RESUM_SQL} FROM cells_all GROUP BY 1, 2, 3)""")


def units(spark, sf):
    return RO.deltas(cells(spark, sf, ALL, KEYS), ["model_family", "period_id", "seed"])


@query("h10_seed_aggregate", f"""SELECT model_family, count(*)::BIGINT AS n_seeds, {r('avg(f)')} AS mean_macro_f1, {r('stddev_samp(f)')} AS std_macro_f1,
  {r('min(f)')} AS min_macro_f1, {r('avg(d)')} AS mean_delta FROM (SELECT model_family, seed, {f1()} AS f, {delta()} AS d FROM
  (SELECT model_family, seed, {RESUM_SQL} FROM cells_all GROUP BY 1, 2)) GROUP BY 1""")
def h10(spark, sf):
    s = RO.deltas(cells(spark, sf, ALL, KEYS), ["model_family", "seed"])
    return rounded(s.groupBy("model_family").agg(
        F.count("*").alias("n_seeds"), F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_samp("macro_f1").alias("std_macro_f1"),
        F.min("macro_f1").alias("min_macro_f1"), F.avg("delta_vs_dummy").alias("mean_delta")))


ADDENDUM_SEEDS = tuple(range(301, 307))
cte("scored_addendum", _scored.format(where=f"m.model_family = '{P.PRIMARY}'").replace(
    "seeds s", "(SELECT unnest([" + ", ".join(map(str, ADDENDUM_SEEDS)) + "])::INTEGER AS seed) s"))


@query("h11_seed_dispersion", f"""WITH t AS (SELECT seed, ticker, {delta()} AS d FROM (SELECT seed, ticker, {SUMS_SQL} FROM scored_addendum GROUP BY 1, 2)),
  s AS (SELECT seed, {f1()} AS macro_f1, {delta()} AS delta_vs_dummy, pt AS positive_ticker_count FROM (SELECT seed, {SUMS_SQL} FROM scored_addendum GROUP BY 1)
    JOIN (SELECT seed, count_if(d > 0) AS pt FROM t GROUP BY 1) USING (seed))
  SELECT '{P.PRIMARY}' AS model_family, count(*)::BIGINT AS n_seeds, """ + ", ".join(
    f"{r(f'{fn}({c})')} AS {fn}_{c}" for c in ("macro_f1", "delta_vs_dummy", "positive_ticker_count") for fn in ("min", "median", "max")) + f""",
  {r('avg(macro_f1)')} AS mean_macro_f1, {r('stddev_samp(macro_f1)')} AS std_macro_f1, {r('avg(delta_vs_dummy)')} AS mean_delta_vs_dummy,
  count_if(delta_vs_dummy > 0)::BIGINT AS n_seeds_delta_positive FROM s""")
def h11(spark, sf):
    """Six more seeds of the primary: spread of macro-F1, delta and positive tickers."""
    c = P.counted(spark, sf, ["model_family", "seed", "ticker"], seeds=ADDENDUM_SEEDS)
    per = RO.deltas(c, ["model_family", "seed"])
    pos = RO.positive_counts(RO.deltas(c, ["model_family", "seed", "ticker"]), ["model_family", "seed"])
    return rounded(RO.seed_dispersion(per.join(pos, ["model_family", "seed"]), ["model_family"]))


@query("h12_period_summary", f"""SELECT model_family, period_id, {r('avg(f)')} AS mean_macro_f1, {r('avg(d)')} AS mean_delta_vs_dummy FROM unit_delta GROUP BY 1, 2""")
def h12(spark, sf):
    return rounded(units(spark, sf).groupBy("model_family", "period_id").agg(
        F.avg("macro_f1").alias("mean_macro_f1"), F.avg("delta_vs_dummy").alias("mean_delta_vs_dummy")))


@query("h13_comparison_table", f"""SELECT model_family, {r('avg(f)')} AS mean_macro_f1, {r('stddev_pop(f)')} AS std_macro_f1, {r('avg(d)')} AS mean_delta_vs_dummy,
  {r('avg(b)')} AS dummy_mean_macro_f1, (SELECT count_if(x > 0) FROM (SELECT avg(d) AS x FROM unit_delta v WHERE v.model_family = u.model_family GROUP BY period_id))::BIGINT AS periods_positive,
  count(DISTINCT period_id)::BIGINT AS n_periods FROM unit_delta u GROUP BY model_family""")
def h13(spark, sf):
    return rounded(RO.comparison_table(cells(spark, sf, ALL, KEYS)))


_D = "CASE WHEN fit_status = 'completed' THEN delta_vs_dummy END"
_M = "CASE WHEN fit_status = 'completed' THEN delta_vs_majority END"


def _ok(c):
    return f"CASE WHEN fit_status = 'completed' THEN {c} END"


HPO_SQL = f"""SELECT candidate_id, model_family, hpo_profile_id, count(*)::BIGINT AS expected_rows, count_if(fit_status = 'completed')::BIGINT AS completed_rows,
  count_if(fit_status <> 'completed')::BIGINT AS failed_rows, avg({_ok('macro_f1')}) AS mean_macro_f1, avg({_ok('balanced_accuracy')}) AS mean_balanced_accuracy,
  avg({_ok('mcc')}) AS mean_mcc, avg({_D}) AS mean_delta_vs_dummy, {lcb(_D)} AS lcb_delta_vs_dummy, avg({_M}) AS mean_delta_vs_majority,
  {lcb(_M)} AS lcb_delta_vs_majority, min({_ok('positive_ticker_count')}) AS min_positive_ticker_count, avg({_ok('positive_ticker_count')}) AS mean_positive_ticker_count
  FROM ledger GROUP BY 1, 2, 3"""
cte("hpo", HPO_SQL)
_hpo_cols = ["mean_macro_f1", "mean_balanced_accuracy", "mean_mcc", "mean_delta_vs_dummy", "lcb_delta_vs_dummy", "mean_delta_vs_majority",
             "lcb_delta_vs_majority", "mean_positive_ticker_count"]


@query("h14_hpo_summary", "SELECT candidate_id, model_family, hpo_profile_id, expected_rows, completed_rows, failed_rows, min_positive_ticker_count, "
       + ", ".join(f"{r(c)} AS {c}" for c in _hpo_cols) + " FROM hpo")
def h14(spark, sf):
    return rounded(RO.hpo_summary(ledger(spark, sf)))


cte("famstat", f"""SELECT candidate_id, model_family, avg(delta_vs_dummy) AS mean_delta, {lcb('delta_vs_dummy')} AS lcb_delta, avg(positive_ticker_count) AS pos
  FROM ledger WHERE fit_status = 'completed' GROUP BY 1, 2""")
cte("screening", """SELECT candidate_id, mean_macro_f1, n_samples_total, median_mean_delta, median_family_lcb, min_family_lcb, best_screening_family, best_family_lcb,
    positive_ticker_count, positive_family_count, seed_std, fold_std FROM
  (SELECT candidate_id, avg(macro_f1) AS mean_macro_f1, sum(n_rows)::BIGINT AS n_samples_total FROM ledger WHERE fit_status = 'completed' GROUP BY 1)
  JOIN (SELECT candidate_id, median(mean_delta) AS median_mean_delta, median(lcb_delta) AS median_family_lcb, min(lcb_delta) AS min_family_lcb,
    arg_max(model_family, row(lcb_delta, mean_delta, model_family)) AS best_screening_family, arg_max(lcb_delta, row(lcb_delta, mean_delta, model_family)) AS best_family_lcb,
    floor(median(pos))::BIGINT AS positive_ticker_count, count_if(mean_delta > 0)::BIGINT AS positive_family_count FROM famstat GROUP BY 1) USING (candidate_id)
  JOIN (SELECT candidate_id, coalesce(stddev_samp(m), 0) AS seed_std FROM (SELECT candidate_id, seed, avg(macro_f1) AS m FROM ledger WHERE fit_status = 'completed' GROUP BY 1, 2) GROUP BY 1) USING (candidate_id)
  JOIN (SELECT candidate_id, coalesce(stddev_samp(m), 0) AS fold_std FROM (SELECT candidate_id, fold_id, avg(macro_f1) AS m FROM ledger WHERE fit_status = 'completed' GROUP BY 1, 2) GROUP BY 1) USING (candidate_id)""")


@query("h15_candidate_screening", f"""SELECT candidate_id, {r('mean_macro_f1')} AS mean_macro_f1, n_samples_total, {r('median_mean_delta')} AS median_mean_delta,
  {r('median_family_lcb')} AS median_family_lcb, {r('min_family_lcb')} AS min_family_lcb, best_screening_family, {r('best_family_lcb')} AS best_family_lcb,
  positive_ticker_count, positive_family_count, {r('seed_std')} AS seed_std_macro_f1, {r('fold_std')} AS fold_id_std_macro_f1 FROM screening""")
def h15(spark, sf):
    return rounded(RO.candidate_screening(ledger(spark, sf)))


@query("h16_ablation_summary", f"""WITH a AS (SELECT model_family, count(*)::BIGINT AS n_trials, count_if(fit_status = 'completed')::BIGINT AS n_completed,
    avg({_ok('macro_f1')}) AS mf, avg({_D}) AS md, min({_D}) AS mind, avg({_M}) AS mm, avg({_ok('positive_ticker_count')}) AS pt FROM ledger GROUP BY 1)
  SELECT a.model_family, a.n_trials, a.n_completed, {r('a.mf')} AS mean_macro_f1, {r('a.md')} AS mean_delta, {r('a.mind')} AS min_delta, {r('a.mm')} AS mean_delta_vs_majority,
  {r('a.pt')} AS positive_ticker_count_mean, {r('b.mf')} AS reference_mean_macro_f1, {r('b.md')} AS reference_mean_delta, {r('a.md - b.md')} AS gap_to_reference_mean_delta
  FROM a, a b WHERE b.model_family = '{P.PRIMARY}' AND a.model_family <> '{P.PRIMARY}'""")
def h16(spark, sf):
    return rounded(RO.ablation_summary(ledger(spark, sf), P.PRIMARY))


AGG_SQL = f"""count(*)::BIGINT AS expected_rows, count_if(fit_status = 'completed')::BIGINT AS completed_rows, count_if(fit_status <> 'completed')::BIGINT AS failed_rows,
  avg({_D}) AS mean_delta, {lcb(_D)} AS lcb_delta, count_if({_D} > 0)::BIGINT AS positive_sign_rows, count_if({_D} < 0)::BIGINT AS negative_sign_rows,
  count_if({_D} = 0)::BIGINT AS zero_sign_rows, avg({_ok('dummy_macro_f1')}) AS mean_dummy_macro_f1, min({_ok('positive_ticker_count')}) AS min_positive_ticker_count,
  avg({_ok('positive_ticker_count')}) AS mean_positive_ticker_count"""
cte("arms", f"SELECT candidate_id, hpo_profile_id, {AGG_SQL} FROM ledger GROUP BY 1, 2")


@query("h17_group_aggregates", f"""SELECT candidate_id, hpo_profile_id, expected_rows, completed_rows, failed_rows, {r('mean_delta')} AS mean_delta, {r('lcb_delta')} AS lcb_delta,
  positive_sign_rows, negative_sign_rows, zero_sign_rows, {r('mean_dummy_macro_f1')} AS mean_dummy_macro_f1, min_positive_ticker_count,
  {r('mean_positive_ticker_count')} AS mean_positive_ticker_count FROM arms""")
def h17(spark, sf):
    return rounded(RO.group_aggregates(ledger(spark, sf), ["candidate_id", "hpo_profile_id"]))


@query("h18_budget_ledger", """SELECT coalesce(fold_id, 'total') AS stage_name, sum(n_rows)::BIGINT AS scoring_events FROM ledger GROUP BY ROLLUP (fold_id)""")
def h18(spark, sf):
    return RO.budget_ledger(ledger(spark, sf), "fold_id", "n_rows")


AUDIT = [("mean_f1", "fit_status = 'completed'", "macro_f1", "mean", 100.0, 1, "51.4"),
         ("max_delta", "model_family = 'boosted'", "delta_vs_dummy", "max", 100.0, 2, "7.77"),
         ("rows_set_F", "candidate_id = 'set_F'", "n_rows", "sum", 1.0, 0, "207000"),
         ("first_balanced", "model_family <> 'boosted'", "balanced_accuracy", "first", 100.0, 1, "50.0"),
         ("tickers_per_1000_rows", "seed > 0", "positive_ticker_count/n_rows", "ratio", 1000.0, 3, "0.1"),
         ("missing_family", "model_family = 'absent'", "macro_f1", "mean", 1.0, 3, "0.5")]
AUDIT_ORDER = ["candidate_id", "model_family", "hpo_profile_id", "fold_id", "seed"]


def _aud_value(where: str, field: str, how: str) -> str:
    case = lambda c: f"CASE WHEN {where} THEN {c} END"
    if how == "first":
        return f"(SELECT {field} FROM ledger WHERE {where} ORDER BY {', '.join(AUDIT_ORDER)} LIMIT 1)"
    if how == "ratio":
        over, under = field.split("/")
        return f"(SELECT sum({case(over)}) / nullif(sum({case(under)})::DOUBLE, 0) FROM ledger)"
    return f"(SELECT { {'mean': 'avg'}.get(how, how) }({case(field)}) FROM ledger)"


_aud = " UNION ALL ".join(
    f"SELECT '{i}' AS number_id, round(({_aud_value(w, f, a)} * {s}::DOUBLE)::DECIMAL(38,12), {d})::DOUBLE AS derived, {p}::DOUBLE AS printed"
    for i, w, f, a, s, d, p in AUDIT)


@query("h19_table_audit", f"""SELECT number_id, derived, printed, CASE WHEN derived IS NULL THEN 'unresolved' WHEN abs(derived - printed) < 1e-9 THEN 'match' ELSE 'mismatch' END AS status FROM ({_aud})""")
def h19(spark, sf):
    return RO.audit_numbers(ledger(spark, sf), AUDIT, AUDIT_ORDER)


# ---- I: calibration and selective risk -------------------------------------------------

BINS = [5, 10, 15]
cte("cal_views", """SELECT seed, ticker, sample_id, y_true, 'p_up' AS view, p_up AS value, y_true AS outcome FROM scored_one
  UNION ALL SELECT seed, ticker, sample_id, y_true, 'top_label_confidence', greatest(p_up, 1 - p_up), (y_true = y_pred)::INTEGER FROM scored_one""")
cte("cal_scopes", """SELECT seed, 'pooled' AS ticker, y_true, view, value, outcome FROM cal_views
  UNION ALL SELECT seed, ticker, y_true, view, value, outcome FROM cal_views WHERE view = 'p_up'""")
cte("cal_edges", " UNION ALL ".join(
    f"""SELECT seed, ticker, view, {n} AS n_bins, 'equal_mass' AS binning_scheme,
      list_sort(list_distinct(quantile_cont(value, [{', '.join(repr(i / n) for i in range(n + 1))}]))) AS edges FROM cal_scopes GROUP BY 1, 2, 3
    UNION ALL SELECT DISTINCT seed, ticker, view, {n}, 'equal_width', [{', '.join(repr(i / n) + '::DOUBLE' for i in range(n + 1))}] FROM cal_scopes""" for n in BINS))
cte("cal_bins", """SELECT seed, ticker, view, binning_scheme, n_bins, bin_index, any_value(edges[bin_index + 1]) AS bin_lower, any_value(edges[bin_index + 2]) AS bin_upper,
    count(*)::BIGINT AS n_rows, avg(value) AS mean_predicted, avg(outcome) AS empirical_frequency, abs(avg(outcome) - avg(value)) AS abs_gap
  FROM (SELECT v.*, e.binning_scheme, e.n_bins, e.edges, greatest(0, least(len(list_filter(e.edges, lambda x: x <= v.value)) - 1, len(e.edges) - 2))::INTEGER AS bin_index
    FROM cal_scopes v JOIN cal_edges e USING (seed, ticker, view) WHERE v.ticker = 'pooled' OR (e.binning_scheme = 'equal_mass' AND e.n_bins = 10))
  GROUP BY 1, 2, 3, 4, 5, 6""")
cte("cal_summary", """SELECT b.*, s.n_rows, s.mean_predicted, s.base_rate_up, CASE WHEN b.view = 'p_up' THEN s.brier END AS brier_score FROM
  (SELECT seed, ticker, view, binning_scheme, n_bins, sum(n_rows * abs_gap) / sum(n_rows) AS ece, max(abs_gap) AS mce,
    CASE WHEN view = 'p_up' THEN sum(n_rows * (mean_predicted - empirical_frequency) ** 2) / sum(n_rows) END AS brier_reliability,
    CASE WHEN view = 'p_up' THEN sum(n_rows * (empirical_frequency - base) ** 2) / sum(n_rows) END AS brier_resolution,
    CASE WHEN view = 'p_up' THEN max(base * (1 - base)) END AS brier_uncertainty
   FROM (SELECT *, sum(n_rows * empirical_frequency) OVER w / sum(n_rows) OVER w AS base FROM cal_bins
     WINDOW w AS (PARTITION BY seed, ticker, view, binning_scheme, n_bins)) GROUP BY 1, 2, 3, 4, 5) b
  JOIN (SELECT seed, ticker, view, count(*) AS n_rows, avg(value) AS mean_predicted, avg(y_true) AS base_rate_up, avg((value - outcome) ** 2) AS brier
    FROM cal_scopes GROUP BY 1, 2, 3) s USING (seed, ticker, view)""")
CAL_STATS = ["ece", "mce", "brier_score", "brier_reliability", "brier_resolution", "brier_uncertainty", "mean_predicted", "base_rate_up"]


def calibration(spark, sf):
    return CAL.calibration_frames(stored(spark, sf, None, "seed", "ticker", "y_true", "y_pred", "p_up"), BINS, ("p_up", "equal_mass", 10))


@query("i1_reliability_bins", f"""SELECT seed, view, binning_scheme, n_bins, bin_index, {r('bin_lower')} AS bin_lower, {r('bin_upper')} AS bin_upper, n_rows,
  {r('mean_predicted')} AS mean_predicted, {r('empirical_frequency')} AS empirical_frequency, {r('abs_gap')} AS abs_gap FROM cal_bins WHERE ticker = 'pooled'""")
def i1(spark, sf):
    return rounded(calibration(spark, sf)[1])


@query("i2_calibration_errors", f"""SELECT seed, view, binning_scheme, n_bins, {r('ece')} AS ece, {r('mce')} AS mce FROM cal_summary WHERE ticker = 'pooled'""")
def i2(spark, sf):
    return rounded(CAL.calibration_errors(calibration(spark, sf)[1], ["seed", "view", "binning_scheme", "n_bins"]))


@query("i3_brier_decomposition", f"""SELECT seed::VARCHAR AS seed, binning_scheme, n_bins, {r('brier_score')} AS brier_score, {r('brier_reliability')} AS brier_reliability,
  {r('brier_resolution')} AS brier_resolution, {r('brier_uncertainty')} AS brier_uncertainty FROM cal_summary WHERE ticker = 'pooled' AND view = 'p_up'""")
def i3(spark, sf):
    s = calibration(spark, sf)[0].filter("ticker = 'pooled' and view = 'p_up' and seed <> 'seed_mean'")
    return rounded(s.select("seed", "binning_scheme", "n_bins", "brier_score", "brier_reliability", "brier_resolution", "brier_uncertainty"))


@query("i4_calibration_summary", f"""SELECT seed::VARCHAR AS seed, ticker, view, binning_scheme, n_bins, n_rows::BIGINT AS n_rows, {', '.join(f'{r(c)} AS {c}' for c in CAL_STATS)} FROM cal_summary
  UNION ALL SELECT 'seed_mean', ticker, view, binning_scheme, n_bins, sum(n_rows)::BIGINT, {', '.join(r(f'avg({c})') for c in CAL_STATS)} FROM cal_summary WHERE ticker = 'pooled' GROUP BY 2, 3, 4, 5""")
def i4(spark, sf):
    return rounded(calibration(spark, sf)[0].select("seed", "ticker", "view", "binning_scheme", "n_bins", "n_rows", *CAL_STATS))


cte("ranked", """SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY seed) AS nn, sum(correct) OVER (w ROWS UNBOUNDED PRECEDING) AS cc,
    sum(y_true) OVER (w ROWS UNBOUNDED PRECEDING) AS cp, sum(y_pred) OVER (w ROWS UNBOUNDED PRECEDING) AS cpp, sum(y_true * y_pred) OVER (w ROWS UNBOUNDED PRECEDING) AS ctp
  FROM (SELECT *, greatest(p_up, 1 - p_up) AS confidence, (y_true = y_pred)::INTEGER AS correct FROM scored_one)
  WINDOW w AS (PARTITION BY seed ORDER BY confidence DESC, sample_id)""")


def ranked(spark, sf, keep_tie=False):
    return R.confidence_rank(SEL.with_confidence(stored(spark, sf, None, "seed", "sample_id", "y_true", "y_pred", "p_up"), ["seed"]), ["seed"], keep_tie=keep_tie)


@query("i5_risk_coverage_curve", f"""SELECT seed, rk AS n_covered, {r('rk::DOUBLE / nn')} AS coverage, {r('confidence')} AS confidence_at_coverage,
  {r('1.0::DOUBLE - cc::DOUBLE / rk')} AS selective_risk, {r('cc::DOUBLE / rk')} AS selective_accuracy FROM ranked""")
def i5(spark, sf):
    return rounded(SEL.risk_coverage_curve(ranked(spark, sf), ["seed"]))


cte("aurc_sql", """SELECT seed, count(*)::BIGINT AS n_rows, avg(1.0::DOUBLE - cc::DOUBLE / rk) AS aurc,
    avg(1.0::DOUBLE - least(rk, tot)::DOUBLE / rk) AS oracle_aurc, avg((1.0::DOUBLE - cc::DOUBLE / rk) * rk / nn) AS augrc, 1 - max(tot)::DOUBLE / count(*) AS full_coverage_risk,
    avg(CASE WHEN rk >= ceil(round(0.5 * nn, 9)) THEN 1.0::DOUBLE - cc::DOUBLE / rk END) AS partial_aurc
  FROM (SELECT *, sum(correct) OVER (PARTITION BY seed) AS tot FROM ranked) GROUP BY 1""")


@query("i6_aurc", f"""SELECT seed, n_rows, {r('aurc')} AS aurc, {r('oracle_aurc')} AS oracle_aurc, {r('aurc - oracle_aurc')} AS e_aurc, {r('full_coverage_risk')} AS full_coverage_risk FROM aurc_sql""")
def i6(spark, sf):
    return rounded(R.selective_summary(ranked(spark, sf), ["seed"]).drop("augrc"))


@query("i7_augrc", f"""SELECT seed, {r('augrc')} AS augrc FROM aurc_sql""")
def i7(spark, sf):
    return rounded(R.selective_summary(ranked(spark, sf), ["seed"]).select("seed", "augrc"))


@query("i8_selective_grid", f"""WITH g AS (SELECT unnest(range(191)) AS i), n AS (SELECT seed, max(nn) AS nn FROM ranked GROUP BY 1),
  k AS (SELECT seed, i, greatest(1, least(nn, ceil(round((0.05::DOUBLE + i * 0.005::DOUBLE) * nn, 9))))::BIGINT AS k FROM g, n)
  SELECT seed, rk AS n_covered, {r('rk::DOUBLE / nn')} AS coverage, {r('confidence')} AS confidence_at_coverage, {r('1.0::DOUBLE - cc::DOUBLE / rk')} AS selective_risk,
    {r('cc::DOUBLE / rk')} AS selective_accuracy, {r(f1('rk', 'cp', 'cpp', 'ctp'))} AS selective_macro_f1 FROM k JOIN ranked USING (seed) WHERE rk = k""")
def i8(spark, sf):
    return rounded(SEL.selective_grid(ranked(spark, sf), ["seed"]))


@query("i8_selective_summary", f"""SELECT a.seed, a.n_rows, {r('aurc')} AS aurc, {r('oracle_aurc')} AS oracle_aurc, {r('aurc - oracle_aurc')} AS e_aurc,
  {r('full_coverage_risk')} AS full_coverage_risk, {r('f')} AS full_coverage_macro_f1 FROM aurc_sql a JOIN (SELECT seed, {f1()} AS f FROM (SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1)) USING (seed)""")
def i8b(spark, sf):
    s = R.selective_summary(ranked(spark, sf), ["seed"]).drop("augrc")
    m = RO.metrics(cells(spark, sf), ["seed"]).select("seed", F.col("macro_f1").alias("full_coverage_macro_f1"))
    return rounded(s.join(m, "seed"))


@query("i9_partial_aurc", f"""SELECT seed, {r('partial_aurc')} AS partial_aurc FROM aurc_sql""")
def i9(spark, sf):
    return rounded(R.selective_summary(ranked(spark, sf), ["seed"], onset=0.5).select("seed", "partial_aurc"))


@query("e17_prefix_accuracy", f"""SELECT seed, (rk - 1) // 1000 AS rank_block, {r('avg(cc::DOUBLE / rk)')} AS mean_prefix_accuracy, max(cc)::BIGINT AS last_correct FROM ranked GROUP BY 1, 2""")
def e17(spark, sf):
    c = R.prefix_sums(ranked(spark, sf), ["seed"], {"cum": F.col("correct")})
    return rounded(c.groupBy("seed", F.floor((F.col("rk") - 1) / 1000).alias("rank_block")).agg(
        F.avg(ratio("cum", "rk")).alias("mean_prefix_accuracy"), F.max("cum").alias("last_correct")))


@query("e18_selective_order", f"""SELECT seed, sample_id, rk FROM ranked""")
def e18(spark, sf):
    return ranked(spark, sf, keep_tie=True).select("seed", "sample_id", "rk")
