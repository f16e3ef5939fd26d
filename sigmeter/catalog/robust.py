"""Queries over resampling, slices, leave-one-out, multiplicity and microstructure."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import confusion as C
from ..operators import joins as J, micro as MI, readouts as RO, resample as RS, selective as SEL, slices as SL
from ..session import materialise
from ..sources import predictions as P, tape as TP
from .base import (RESUM_SQL, SUMS_SQL, bf1, cf1, cte, delta, div, f1, hx, lcb, query, r, rounded)
from .scoring import ACC, ALL, cells, ledger, stored, units

N_BOOT, BOOT_SEED = 1000, 12345
N_PERM, PERM_SEED = 200, 20260617
N_PERM_GUARDED = 50  # k10 alone
LOO_AXES = ["ticker", "seed", "calendar_year", "calendar_quarter", "time_of_day_hour", "activity_tercile"]


TREE_HEIGHT = 14  # the SQL form covers 2**14 blocks a slice


def _mix_sql(source: str, c: str) -> str:
    step = f"(xor({c}, {c} >> 16) * 73244475) & 4294967295"
    return f"SELECT * REPLACE (xor({c}, {c} >> 16) AS {c}) FROM (SELECT * REPLACE ({step} AS {c}) FROM (SELECT * REPLACE ({step} AS {c}) FROM ({source})))"


def boot_sql(name: str, blocks: str, keys: list[str], n_boot: int, sums: list[str], block: str = "ticker || '|' || trading_day") -> None:
    """CTEs <name>_idx, <name>_h0 (draw, p: block index, c: times picked) and <name>_draws for a block table.

    The splitting tree level by level; binomials are inverted on cumulated log-gamma masses.
    """
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cte(f"{name}_idx", f"SELECT *, row_number() OVER ({part}ORDER BY sha256({block})) - 1 AS idx, count(*) OVER ({part}) AS n_blocks FROM {blocks}", True)
    cte(f"{name}_dr", _mix_sql(f"SELECT draw, (draw * 2246822519 + 1) & 4294967295 AS hd FROM (SELECT unnest(range({n_boot})) AS draw)", "hd"), True)
    cte(f"{name}_h{TREE_HEIGHT}", f"SELECT {k}draw, hd, 0::BIGINT AS p, n_blocks AS n, n_blocks AS c FROM (SELECT DISTINCT {k}n_blocks FROM {name}_idx), {name}_dr", True)
    for h in range(TREE_HEIGHT, 0, -1):
        half = 1 << (h - 1)
        cte(f"{name}_s{h}", f"SELECT *, least({2 * half}, n - p * {2 * half}) AS size, {half}::DOUBLE / least({2 * half}, n - p * {2 * half}) AS q FROM {name}_h{h}", True)
        cte(f"{name}_c{h}", f"""SELECT c, q, min(j) AS lo, list(cdf ORDER BY j) AS cdf FROM (SELECT c, q, j, sum(pmf) OVER (PARTITION BY c, q ORDER BY j) AS cdf FROM
  (SELECT c, q, j, exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(q) + (c - j) * ln(1 - q)) AS pmf FROM
  (SELECT c, q, unnest(range(greatest(0, mode - w), least(c, mode + w) + 1)) AS j FROM (SELECT c, q, least(floor((c + 1) * q)::BIGINT, c) AS mode, floor(12 * sqrt(c * q * (1 - q)))::BIGINT + 24 AS w
  FROM (SELECT DISTINCT c, q FROM {name}_s{h} WHERE size > {half}))))) GROUP BY 1, 2""", True)
        node = _mix_sql(f"SELECT *, ((p * 64 + {h}) * 2654435761 + {BOOT_SEED}) & 4294967295 AS x FROM {name}_s{h}", "x")
        both = _mix_sql(f"SELECT * REPLACE (xor(x, hd) AS x) FROM ({node})", "x")
        split = f"""SELECT {k}draw, hd, p, n, c, CASE WHEN size <= {half} THEN c ELSE least(c, lo + len(list_filter(cdf, lambda y: y <= u)))::BIGINT END AS l
  FROM (SELECT z.*, t.lo, t.cdf, (z.x + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM ({both}) z LEFT JOIN {name}_c{h} t ON t.c = z.c AND t.q = z.q)"""
        cte(f"{name}_h{h - 1}", f"SELECT {k}draw, hd, 2 * p + side AS p, n, CASE side WHEN 0 THEN l ELSE c - l END AS c FROM ({split}), (SELECT unnest(range(2)) AS side) WHERE CASE side WHEN 0 THEN l ELSE c - l END > 0", True)
    on = " AND ".join([f"b.{c} = g.{c}" for c in keys] + ["b.idx = g.p"])
    gk = "".join(f"g.{c}, " for c in keys)
    if sums:
        cte(f"{name}_draws", f"""SELECT {gk}g.draw, {', '.join(f'sum(b.{s} * g.c) AS {s}' for s in sums)}, max(g.n) AS n_blocks
      FROM {name}_h0 g JOIN {name}_idx b ON {on} GROUP BY {gk}g.draw""")


SIX = ["n", "p", "pp", "tp", "bp", "btp"]
cte("seed_blocks", f"SELECT seed, ticker, trading_day, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3")
boot_sql("k1", "seed_blocks", ["seed"], 1000, SIX)
cte("k1_ci", f"""SELECT d.seed, max(o.point) AS point, avg(d.d) AS mean, quantile_cont(d.d, 0.025) AS lcb, quantile_cont(d.d, 0.975) AS ucb, max(d.n_blocks)::BIGINT AS n_blocks
  FROM (SELECT seed, n_blocks, {delta()} AS d FROM k1_draws) d JOIN (SELECT seed, {delta()} AS point FROM (SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1)) o USING (seed) GROUP BY 1""")


@query("k1_block_bootstrap", f"""SELECT seed, {r('point')} AS point, {r('mean')} AS mean, {r('lcb')} AS lcb, {r('ucb')} AS ucb, n_blocks FROM k1_ci""")
def k1(spark, sf):
    return rounded(RS.block_bootstrap(cells(spark, sf), ["seed"], 1000, BOOT_SEED))


@query("k2_minimum_detectable_effect", f"""SELECT seed, {r('point')} AS point, {r('mean')} AS mean, {r('lcb')} AS lcb, {r('ucb')} AS ucb, n_blocks,
  {r('mean - lcb')} AS mde, {r('(ucb - lcb) / 2')} AS mde_symmetric, lcb > 0 AS clears_zero FROM k1_ci""")
def k2(spark, sf):
    return rounded(RS.minimum_detectable_effect(RS.block_bootstrap(cells(spark, sf), ["seed"], 1000, BOOT_SEED)))


def hg(u: str, n: str, k: str, d: str) -> str:
    """Inverse distribution from log-gamma masses: a second form of the sampler."""
    def lg(x):
        return f"lgamma(({x})::DOUBLE + 1)"
    pmf = (f"exp({lg(k)} - {lg('z')} - {lg(f'({k}) - z')} + {lg(f'({n}) - ({k})')} - {lg(f'({d}) - z')} - {lg(f'({n}) - ({k}) - ({d}) + z')}"
           f" - {lg(n)} + {lg(d)} + {lg(f'({n}) - ({d})')})")
    lo, hi = f"greatest(0, ({d}) + ({k}) - ({n}))::BIGINT", f"least(({d}), ({k}))::BIGINT"
    cdf = f"list_sum(list_transform(range({lo}, y + 1), lambda z: {pmf}))"
    return f"least({hi}, {lo} + len(list_filter(range({lo}, {hi} + 1), lambda y: {cdf} <= {u})))::BIGINT"


cte("shuf0", f"""SELECT b.*, draw, sha256('{PERM_SEED}|' || draw || '|' || seed || '|' || ticker || '|' || trading_day) AS h
  FROM seed_blocks b, (SELECT unnest(range({N_PERM})) AS draw)""")
cte("shuf1", f"SELECT *, {hg(hx('h', 1), 'n', 'p', 'q11')} AS xa FROM shuf0")
cte("shuf2", f"SELECT *, {hg(hx('h', 14), 'n - q11', 'p - xa', 'pp - q11')} AS xb FROM shuf1")
cte("shuf3", f"SELECT *, {hg(hx('h', 27), 'n - pp', 'p - xa - xb', 'bp - q11')} AS xc FROM shuf2")
cte("shuf_null", f"""SELECT seed, draw, {delta()} AS d FROM (SELECT seed, draw, sum(n) AS n, sum(p) AS p, sum(pp) AS pp, sum(bp) AS bp, sum(xa + xb) AS tp, sum(xa + xc) AS btp FROM shuf3 GROUP BY 1, 2)""")
cte("shuf_sum", f"""SELECT seed, max(o.n)::BIGINT AS n_rows, max(o.nb)::BIGINT AS n_blocks, max(o.obs) AS observed_delta, avg(d) AS label_shuffle_mean, stddev_samp(d) AS label_shuffle_sd,
    quantile_cont(d, 0.95) AS label_shuffle_p95, (1 + count_if(d >= o.obs))::DOUBLE / {N_PERM + 1} AS label_shuffle_p_value
  FROM shuf_null JOIN (SELECT seed, nb, n, {delta()} AS obs FROM (SELECT seed, count(*) AS nb, {RESUM_SQL} FROM seed_blocks GROUP BY 1)) o USING (seed) GROUP BY 1""")


@query("k3_label_shuffle", f"""SELECT seed, n_rows, n_blocks, {r('observed_delta')} AS observed_delta, {r('label_shuffle_mean')} AS label_shuffle_mean, {r('label_shuffle_sd')} AS label_shuffle_sd,
  {r('label_shuffle_p95')} AS label_shuffle_p95, {r('label_shuffle_p_value')} AS label_shuffle_p_value FROM shuf_sum""")
def k3(spark, sf):
    return rounded(RS.label_shuffle(cells(spark, sf), ["seed"], N_PERM, PERM_SEED))


cte("mirrored", """SELECT a.seed, a.ticker, a.trading_day, a.y_true, b.y_pred, a.base_pred FROM
  (SELECT *, row_number() OVER (PARTITION BY seed, ticker, trading_day ORDER BY target_timestamp, sample_id) AS i FROM scored_one) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY seed, ticker, trading_day ORDER BY target_timestamp DESC, sample_id DESC) AS i FROM scored_one) b USING (seed, ticker, trading_day, i)""")
cte("reversed", f"SELECT seed, {delta()} AS time_reverse_delta FROM (SELECT seed, {SUMS_SQL} FROM mirrored GROUP BY 1)")


REVERSED = ["seed", "ticker", "trading_day", "target_timestamp", "sample_id", "y_true", "y_pred", "base_pred"]  # what a reversal reads


@query("k4_time_reverse", f"SELECT seed, {r('time_reverse_delta')} AS time_reverse_delta FROM reversed")
def k4(spark, sf):
    return rounded(RS.time_reverse(stored(spark, sf, None, *REVERSED), ["seed"]))


@query("e21_within_block_reverse", """SELECT seed, count(*)::BIGINT AS n, sum(y_true * y_pred)::BIGINT AS tp_reversed FROM mirrored GROUP BY 1""")
def e21(spark, sf):
    return RS.reversed_sums(stored(spark, sf, None, *REVERSED), ["seed"]).select("seed", "n", F.col("tp").alias("tp_reversed"))


@query("k5_metric_lcb", f"""SELECT model_family, {r(lcb('delta_vs_dummy'))} AS lcb, {r('avg(delta_vs_dummy)')} AS mean, count(delta_vs_dummy)::BIGINT AS n_values FROM ledger GROUP BY 1""")
def k5(spark, sf):
    return rounded(RS.metric_lcb(ledger(spark, sf), ["model_family"], "delta_vs_dummy"))


@query("k6_family_cis", f"""SELECT {r('min(lcb)')} AS min_family_lcb, {r('median(lcb)')} AS median_family_lcb, {r('max(mean)')} AS max_family_mean
  FROM (SELECT model_family, {lcb('delta_vs_dummy')} AS lcb, avg(delta_vs_dummy) AS mean FROM ledger GROUP BY 1)""")
def k6(spark, sf):
    return rounded(RS.family_cis(RS.metric_lcb(ledger(spark, sf), ["model_family"], "delta_vs_dummy"), []))


cte("fam_period", "SELECT model_family, period_id, avg(d) AS delta FROM unit_delta GROUP BY 1, 2")
cte("pbo_m", """SELECT dense_rank() OVER (ORDER BY model_family) - 1 AS t, dense_rank() OVER (ORDER BY period_id) - 1 AS b, delta FROM fam_period""")
cte("pbo_dims", "SELECT max(t) + 1 AS nt, max(b) + 1 AS nb, (max(b) + 1) // 2 AS k FROM pbo_m")
cte("pbo_t", """SELECT mask, t, avg(CASE WHEN (mask >> b) & 1 = 1 THEN delta END) AS isp, avg(CASE WHEN (mask >> b) & 1 = 0 THEN delta END) AS osp
  FROM pbo_m, (SELECT unnest(range((1 << (SELECT nb FROM pbo_dims)::INTEGER)))::BIGINT AS mask), pbo_dims WHERE bit_count(mask) = k GROUP BY 1, 2""")
cte("pbo_w", """SELECT mask, arg_max(rk, row(isp, -t)) AS rk FROM (SELECT *, rank() OVER (PARTITION BY mask ORDER BY osp) + (count(*) OVER (PARTITION BY mask, osp) - 1) / 2.0::DOUBLE AS rk FROM pbo_t) GROUP BY 1""")
cte("pbo_one", f"""SELECT {r('count_if(lam < 0)::DOUBLE / count(*)')} AS pbo, count(*)::BIGINT AS n_combinations, max(nt)::BIGINT AS n_trials, max(nb)::BIGINT AS n_blocks,
    max(k)::BIGINT AS is_block_count, (max(nb) - max(k))::BIGINT AS os_block_count, max(nb) = 2 * max(k) AS is_symmetric, {r('median(lam)')} AS median_logit
  FROM (SELECT ln((rk / (nt + 1)) / (1 - rk / (nt + 1))) AS lam, d.* FROM pbo_w, pbo_dims d)""")


def family_period(spark, sf):
    return units(spark, sf).groupBy("model_family", "period_id").agg(F.avg("delta_vs_dummy").alias("delta"))


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("k7_cscv_pbo", "SELECT * FROM pbo_one")
def k7(spark, sf):
    out = RS.cscv_pbo(family_period(spark, sf), trial="model_family", block="period_id", perf="delta")
    return rounded(_long(out, "n_trials", "n_blocks", "is_block_count", "os_block_count"))


cte("bd_values", f"""SELECT model_family, ticker, trading_day, avg(d) AS value, 1 AS one FROM (SELECT model_family, seed, ticker, trading_day, {delta()} AS d
  FROM (SELECT model_family, seed, ticker, trading_day, {RESUM_SQL} FROM cells_all GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3""")
boot_sql("k8", "bd_values", ["model_family"], N_BOOT, ["value", "one"])


@query("k8_block_bootstrap_lcb", f"""SELECT model_family, {r('quantile_cont(m, 0.025)')} AS lcb, {r('avg(m)')} AS mean, max(n_blocks)::BIGINT AS n_blocks
  FROM (SELECT model_family, n_blocks, value / one AS m FROM k8_draws) GROUP BY 1""")
def k8(spark, sf):
    """Block deltas averaged over seeds, then the bootstrap of their mean, per family."""
    keys = ["model_family", "seed", "ticker", "trading_day"]
    bd = RO.deltas(cells(spark, sf, ALL, keys), keys)
    v = bd.groupBy("model_family", "ticker", "trading_day").agg(F.avg("delta_vs_dummy").alias("value"))
    return rounded(RS.bootstrap_mean_lcb(v, ["model_family"], N_BOOT, BOOT_SEED))


@query("k9_sentinel_frames", f"""SELECT seed, n_rows, n_blocks, {r('observed_delta')} AS observed_delta, {r('label_shuffle_mean')} AS label_shuffle_mean, {r('label_shuffle_p95')} AS label_shuffle_p95,
  {r('label_shuffle_p_value')} AS label_shuffle_p_value, {r('time_reverse_delta')} AS time_reverse_delta, {N_PERM} AS n_perm, 'computed' AS sentinel_status FROM shuf_sum JOIN reversed USING (seed)""")
def k9(spark, sf):
    rows = stored(spark, sf, None, *REVERSED)  # predictions are made once for both controls
    s = RS.label_shuffle(RO.block_cells(rows, ["seed"]), ["seed"], N_PERM, PERM_SEED).drop("label_shuffle_sd")
    t = RS.time_reverse(rows, ["seed"])
    return rounded(s.join(t, "seed").withColumns({"n_perm": F.lit(N_PERM), "sentinel_status": F.lit("computed")}))


cte("terc_null", f"""SELECT activity_tercile, seed, draw, {f1()} AS f FROM (SELECT activity_tercile, seed, draw, sum(n) AS n, sum(p) AS p, sum(pp) AS pp, sum(xa + xb) AS tp
  FROM (SELECT s.*, unnest(['all', t.activity_tercile]) AS activity_tercile FROM shuf3 s JOIN day_terciles t USING (ticker, trading_day) WHERE draw < {N_PERM_GUARDED}) GROUP BY 1, 2, 3)""")
cte("terc_seed", f"""SELECT activity_tercile, seed, {RESUM_SQL} FROM (SELECT b.*, unnest(['all', t.activity_tercile]) AS activity_tercile FROM seed_blocks b JOIN day_terciles t USING (ticker, trading_day)) GROUP BY 1, 2""")


@query("k10_guarded_label_shuffle", f"""SELECT activity_tercile, o.n_rows, {r('o.om')} AS observed_macro_f1, {r('o.dm')} AS dummy_macro_f1, {r('o.om - o.dm')} AS observed_delta_vs_dummy, {r('s.sm')} AS shuffled_macro_f1_mean,
  {r('s.sx')} AS shuffled_macro_f1_max, {r('s.sm - o.dm')} AS shuffled_delta_mean, {r('s.sx - o.dm')} AS shuffled_delta_max, {N_PERM_GUARDED} AS n_perms, o.om > s.sx AS observed_exceeds_shuffle_max
  FROM (SELECT activity_tercile, round(avg(n))::BIGINT AS n_rows, avg({f1()}) AS om, avg({bf1()}) AS dm FROM terc_seed GROUP BY 1) o
  JOIN (SELECT activity_tercile, avg(f) AS sm, max(f) AS sx FROM terc_null GROUP BY 1) s USING (activity_tercile)""")
def k10(spark, sf):
    return rounded(SL.guarded_label_shuffle(cells(spark, sf), N_PERM_GUARDED, PERM_SEED))


cte("ticker_blocks", f"SELECT seed, ticker, trading_day, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3")
boot_sql("k11", "ticker_blocks", ["seed", "ticker"], N_BOOT, SIX)


@query("k11_ticker_ci_mean", f"""SELECT ticker, {r('avg(l) * 100')} AS lcb_points, {r('avg(u) * 100')} AS ucb_points, count(*)::BIGINT AS n_seeds FROM
  (SELECT seed, ticker, quantile_cont(d, 0.025) AS l, quantile_cont(d, 0.975) AS u FROM (SELECT seed, ticker, {delta()} AS d FROM k11_draws) GROUP BY 1, 2) GROUP BY 1""")
def k11(spark, sf):
    ci = RS.block_bootstrap(cells(spark, sf), ["seed", "ticker"], N_BOOT, BOOT_SEED)
    return rounded(ci.groupBy("ticker").agg((F.avg("lcb") * 100).alias("lcb_points"), (F.avg("ucb") * 100).alias("ucb_points"),
                                            F.count("*").alias("n_seeds")))


# ---- M ---------------------------------------------------------------------------------

AXES = ["ticker", "activity_tercile", "calendar_year", "calendar_quarter", "time_of_day_hour"]
BOOT_AXES = ["ticker", "activity_tercile", "seed"]
cte("axis_rows", """SELECT s.*, t.activity_tercile, year(target_timestamp)::VARCHAR AS calendar_year, year(target_timestamp) || 'Q' || quarter(target_timestamp) AS calendar_quarter,
  strftime(target_timestamp, '%H') AS time_of_day_hour FROM scored_one s JOIN day_terciles t USING (ticker, trading_day)""")
cte("axis_long", " UNION ALL ".join(f"SELECT seed, ticker, trading_day, '{a}' AS slice_axis, {a}::VARCHAR AS slice_value, y_true, y_pred, base_pred FROM axis_rows" for a in AXES + ["seed"]))
cte("axis_counts", f"SELECT seed, slice_axis, slice_value, {SUMS_SQL} FROM axis_long GROUP BY 1, 2, 3")
cte("axis_blocks", f"SELECT seed, slice_axis, slice_value, ticker, trading_day, {SUMS_SQL} FROM axis_long WHERE slice_axis IN ('ticker', 'activity_tercile', 'seed') GROUP BY 1, 2, 3, 4, 5")
boot_sql("m1", "axis_blocks", ["seed", "slice_axis", "slice_value"], N_BOOT, SIX)
_rest = {c: f"(CASE WHEN a.slice_axis = 'seed' THEN g.{c} ELSE t.{c} END - a.{c})" for c in SIX}
_A = {c: f"a.{c}" for c in SIX}
_T = {c: f"t.{c}" for c in SIX}


def _dl(m):
    return f"({f1(m['n'], m['p'], m['pp'], m['tp'])} - {bf1(m['n'], m['p'], m['bp'], m['btp'])})"


cte("m1_rows", f"""SELECT a.seed, a.slice_axis, a.slice_value, a.n AS n_rows, {f1(*[_A[c] for c in SIX[:4]])} AS macro_f1,
    {f1(*[_A[c] for c in SIX[:4]])} - CASE WHEN mj.maj = 1 THEN {cf1(1, 'a.n', 'a.p')} ELSE {cf1(0, 'a.n', 'a.p')} END AS delta_vs_majority, {_dl(_A)} AS delta_vs_dummy,
    CASE WHEN {_dl(_T)} > 0 AND a.slice_axis <> 'seed' THEN {div('a.n', 't.n')} * {_dl(_A)} / {_dl(_T)} END AS share_of_pooled_positive_delta,
    CASE WHEN a.slice_axis IN ({', '.join(repr(x) for x in LOO_AXES)}) THEN {_dl(_rest)} END AS loo_pooled_delta, b.l AS bootstrap_delta_lcb, b.u AS bootstrap_delta_ucb
  FROM axis_counts a JOIN (SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1) t USING (seed), (SELECT {RESUM_SQL} FROM cells_one) g,
    (SELECT CASE WHEN avg(y_true) > 0.5 THEN 1 ELSE 0 END AS maj FROM facts WHERE yr < 1996) mj
  LEFT JOIN (SELECT seed, slice_axis, slice_value, quantile_cont(d, 0.025) AS l, quantile_cont(d, 0.975) AS u FROM (SELECT *, {delta()} AS d FROM m1_draws) GROUP BY 1, 2, 3) b
    ON b.seed = a.seed AND b.slice_axis = a.slice_axis AND b.slice_value = a.slice_value""")


def hour_cells(spark, sf):
    """Counts per seed, block and hour, with calendar and tercile columns."""
    rows = P.scored(spark, sf)
    c = rows.groupBy("seed", "ticker", "trading_day", F.lpad(F.hour("target_timestamp").cast("string"), 2, "0").alias("time_of_day_hour")).agg(*C.row_sums())
    c = materialise(c, "hour-cells")  # read several times below
    day = F.to_date("trading_day")
    return SL.with_terciles(c).withColumns({"calendar_year": F.year(day).cast("string"), "calendar_quarter": F.concat(F.year(day), F.lit("Q"), F.quarter(day)),
                                            "calendar_month": F.substring("trading_day", 1, 7)})


def robustness(spark, sf):
    return SL.robustness_slices(materialise(hour_cells(spark, sf), "axis-cells"), {a: F.col(a) for a in AXES}, SL.majority_class(spark, sf), BOOT_AXES,
                                LOO_AXES, N_BOOT, BOOT_SEED)


_m1c = ["macro_f1", "delta_vs_majority", "delta_vs_dummy", "share_of_pooled_positive_delta", "loo_pooled_delta", "bootstrap_delta_lcb", "bootstrap_delta_ucb"]


@query("m1_robustness_slices", f"""SELECT seed, slice_axis, slice_value, n_rows, {', '.join(f'{r(c)} AS {c}' for c in _m1c)}, loo_pooled_delta <= 0 AS loo_sign_flip FROM m1_rows""")
def m1(spark, sf):
    return rounded(robustness(spark, sf))


# Beside the flips as they are: flips against the axis mean, of which every axis with unequal slices has some.
@query("m3_concentration_summary", """SELECT variant, slice_axis, array_to_string(list_sort(list(DISTINCT slice_value)), ',') AS flipping_values FROM (
    SELECT 'as_is' AS variant, slice_axis, slice_value, loo_pooled_delta <= 0 AS flips FROM m1_rows
    UNION ALL SELECT 'below_axis_mean', slice_axis, slice_value, round(loo_pooled_delta - avg(loo_pooled_delta) OVER (PARTITION BY slice_axis), 12) < 0 FROM m1_rows) WHERE flips GROUP BY 1, 2""")
def m3(spark, sf):
    rob = materialise(robustness(spark, sf), "robustness")
    mean = F.avg("loo_pooled_delta").over(Window.partitionBy("slice_axis"))  # a few values per axis
    shifted = rob.withColumn("loo_sign_flip", F.round(F.col("loo_pooled_delta") - mean, 12) < 0)
    out = None
    for name, x in (("as_is", rob), ("below_axis_mean", shifted)):
        part = SL.concentration_summary(x).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("flipping_values", F.array_join("flipping_values", ","))


cte("fail_counts", " UNION ALL ".join(
    f"SELECT seed, '{a}' AS slice_axis, {e} AS slice_value, count(*)::BIGINT AS n, sum(y_true)::BIGINT AS p, sum((y_true <> y_pred)::INTEGER)::BIGINT AS errors FROM axis_rows GROUP BY 1, 2, 3"
    for a, e in (("ticker_hour", "ticker || '|' || time_of_day_hour"), ("ticker_trading_day", "ticker || '|' || trading_day"), ("activity_tercile", "activity_tercile"),
                 ("calendar_month", "strftime(target_timestamp, '%Y-%m')"))))
MIN_SLICE, TOP_K = 200, 25


@query("m2_failure_slices", f"""SELECT f.seed, slice_axis, slice_value, f.n AS n_rows, errors AS error_count, {r('er')} AS error_rate, {r('er - pe')} AS error_rate_lift_vs_seed_pooled, f.p AS support_up, f.n - f.p AS support_down
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, slice_axis ORDER BY er DESC, slice_value) AS rk FROM (SELECT *, errors::DOUBLE / n AS er FROM fail_counts WHERE n >= {MIN_SLICE})) f
  JOIN (SELECT seed, avg((y_true <> y_pred)::INTEGER) AS pe FROM scored_one GROUP BY 1) q ON q.seed = f.seed WHERE rk <= {TOP_K}""")
def m2(spark, sf):
    h = hour_cells(spark, sf).withColumn("errors", F.col("p") + F.col("pp") - 2 * F.col("tp"))
    axes = {"ticker_hour": F.concat_ws("|", "ticker", "time_of_day_hour"), "ticker_trading_day": F.concat_ws("|", "ticker", "trading_day"),
            "activity_tercile": F.col("activity_tercile"), "calendar_month": F.col("calendar_month")}
    pairs = F.array(*[F.struct(F.lit(a).alias("slice_axis"), c.alias("slice_value")) for a, c in axes.items()])
    counts = h.withColumn("_x", F.explode(pairs)).groupBy("seed", "_x").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("errors").alias("errors")).select("seed", "_x.*", "n", "p", "errors")
    return rounded(SL.failure_slices(counts, MIN_SLICE, TOP_K))


def _seed_mean_sql(src: str, keys: str, stats: dict[str, str]) -> str:
    per = f"SELECT {keys}, seed::VARCHAR AS seed, n AS n_rows, {', '.join(f'{e} AS {c}' for c, e in stats.items())} FROM {src}"
    mean = f"SELECT {keys}, 'seed_mean' AS seed, round(avg(n_rows))::BIGINT AS n_rows, {', '.join(f'avg({c}) AS {c}' for c in stats)} FROM ({per}) GROUP BY {keys}"
    return f"{per} UNION ALL {mean}"


_m4 = {"macro_f1": f1(), "accuracy": ACC, "dummy_macro_f1": bf1(), "delta_vs_dummy": delta()}
cte("m4_rows", _seed_mean_sql("terc_seed", "activity_tercile", _m4))


@query("m4_guarded_terciles", f"""SELECT activity_tercile, seed, n_rows, {', '.join(f'{r(c)} AS {c}' for c in _m4)}, macro_f1 < 0.5 AS below_random_prior FROM m4_rows""")
def m4(spark, sf):
    return rounded(SL.guarded_terciles(cells(spark, sf)))


cte("m5_counts", f"""SELECT 'period' AS scope, period_id AS slice, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3
  UNION ALL SELECT 'activity_tercile', activity_tercile, seed, n, p, pp, tp, bp, btp, q11 FROM terc_seed WHERE activity_tercile <> 'all'""")
_m5 = {"up_rate": div("p", "n"), "dummy_macro_f1": bf1(), "candidate_macro_f1": f1(), "delta_vs_dummy": delta()}
cte("m5_rows", _seed_mean_sql("m5_counts", "scope, slice", _m5))


@query("m5_guarded_base_rates", f"""SELECT scope, slice, seed, n_rows, {', '.join(f'{r(c)} AS {c}' for c in _m5)} FROM m5_rows""")
def m5(spark, sf):
    return rounded(SL.guarded_base_rates(cells(spark, sf)))


cte("m6_rows", f"""SELECT model_family, avg(d) AS row_pooled_delta FROM (SELECT model_family, seed, {delta()} AS d FROM (SELECT model_family, seed, {RESUM_SQL} FROM cells_all GROUP BY 1, 2)) GROUP BY 1""")
cte("m7_rows", """SELECT model_family, sum(s) / sum(c) AS equal_weight_delta, count_if(m > 0)::BIGINT AS positive_period_count, count(*)::BIGINT AS n_periods
  FROM (SELECT model_family, period_id, avg(d) AS m, sum(d) AS s, count(d) AS c FROM unit_delta GROUP BY 1, 2) GROUP BY 1""")


@query("m6_row_pooled_delta", f"SELECT model_family, {r('row_pooled_delta')} AS row_pooled_delta FROM m6_rows")
def m6(spark, sf):
    return rounded(SL.row_pooled(cells(spark, sf, ALL), ["model_family"]))


@query("m7_equal_weight_delta", f"SELECT model_family, {r('equal_weight_delta')} AS equal_weight_delta, positive_period_count, n_periods FROM m7_rows")
def m7(spark, sf):
    return rounded(SL.equal_weight(cells(spark, sf, ALL), ["model_family"]))


cte("loo_units", f"""SELECT 'equal_weight_over_period' AS estimand, period_id AS left_out, delta AS d FROM fam_period WHERE model_family = '{P.PRIMARY}'
  UNION ALL SELECT 'equal_weight_over_ticker', ticker, avg({delta()}) FROM (SELECT ticker, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2) GROUP BY 1, 2""")
cte("loo_rows", """SELECT estimand, left_out, count(*) OVER w - 1 AS n_units_remaining, (sum(d) OVER w - d) / (count(*) OVER w - 1) AS delta_after_drop, avg(d) OVER w AS baseline_delta
  FROM loo_units WINDOW w AS (PARTITION BY estimand)""")


def loo_rows(spark, sf):
    per = family_period(spark, sf).filter(F.col("model_family") == P.PRIMARY)
    tick = RO.deltas(cells(spark, sf), ["ticker", "seed"]).groupBy("ticker").agg(F.avg("delta_vs_dummy").alias("delta"))
    return SL.equal_weight_loo(per, "equal_weight_over_period", "period_id", "delta").unionByName(
        SL.equal_weight_loo(tick, "equal_weight_over_ticker", "ticker", "delta"))


LOO_COLS = f"""n_units_remaining::BIGINT AS n_units_remaining, {r('delta_after_drop')} AS delta_after_drop, {r('baseline_delta')} AS baseline_delta, {r('delta_after_drop - baseline_delta')} AS delta_shift, delta_after_drop > 0 AS sign_after_drop"""
SUMMARY_SQL = """SELECT estimand, count(*)::BIGINT AS n_units, max(baseline_delta) AS baseline_delta,
  NOT CASE WHEN max(baseline_delta) > 0 THEN bool_or(delta_after_drop <= 0) WHEN max(baseline_delta) < 0 THEN bool_or(delta_after_drop >= 0) ELSE true END AS sign_survives,
  arg_min(left_out, row(delta_after_drop, left_out)) AS worst_drop, min(delta_after_drop) AS worst_after, arg_max(left_out, row(abs(delta_after_drop - baseline_delta), left_out)) AS most_influential"""


@query("m8_equal_weight_loo", f"SELECT estimand, left_out, {LOO_COLS} FROM loo_rows")
def m8(spark, sf):
    return rounded(loo_rows(spark, sf))


@query("m8_equal_weight_loo_summary", f"SELECT * REPLACE ({r('baseline_delta')} AS baseline_delta, {r('worst_after')} AS worst_after) FROM ({SUMMARY_SQL} FROM loo_rows GROUP BY 1)")
def m8s(spark, sf):
    return rounded(SL.loo_summary(loo_rows(spark, sf)))


@query("m9_estimand_contrast", f"""SELECT 'guarded_walkforward' AS evidence_domain, 'row_pooled' AS aggregation, 'row' AS weight_unit, {r('row_pooled_delta')} AS pooled_delta FROM m6_rows WHERE model_family = '{P.PRIMARY}'
  UNION ALL SELECT 'guarded_walkforward', 'equal_weight', 'walkforward_period', {r('equal_weight_delta')} FROM m7_rows WHERE model_family = '{P.PRIMARY}'
  UNION ALL SELECT 'official_validation', 'row_pooled', 'row', {r('delta_vs_dummy')} FROM m4_rows WHERE activity_tercile = 'all' AND seed = 'seed_mean'
  UNION ALL SELECT 'official_validation', 'equal_weight', 'activity_tercile', {r('avg(delta_vs_dummy)')} FROM m4_rows WHERE activity_tercile <> 'all' AND seed = 'seed_mean'""")
def m9(spark, sf):
    return rounded(SL.estimand_contrast(cells(spark, sf)))


cte("rp_long", f"""SELECT 'period_id' AS axis, period_id AS left_out, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3 UNION ALL SELECT 'ticker', ticker, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2, 3""")
cte("rp_tot", f"SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1")
_R = {c: f"(t.{c} - l.{c})" for c in SIX}
cte("rp_rows", f"""SELECT 'row_pooled_over_' || axis AS estimand, left_out, sum(t.n - l.n) AS n_units_remaining, avg({_dl(_R)}) AS delta_after_drop, avg({_dl(_T)}) AS baseline_delta
  FROM rp_long l JOIN rp_tot t USING (seed) GROUP BY 1, 2""")


@query("m10_row_pooled_loo", f"SELECT estimand, left_out, {LOO_COLS} FROM rp_rows")
def m10(spark, sf):
    return rounded(SL.row_pooled_loo(cells(spark, sf), ["period_id", "ticker"]))


@query("m10_row_pooled_loo_summary", f"SELECT * REPLACE ({r('baseline_delta')} AS baseline_delta, {r('worst_after')} AS worst_after) FROM ({SUMMARY_SQL} FROM rp_rows GROUP BY 1)")
def m10s(spark, sf):
    return rounded(SL.loo_summary(SL.row_pooled_loo(cells(spark, sf), ["period_id", "ticker"])))


cte("fam_rows", f"""SELECT model_family, count(*)::BIGINT AS n_periods, count_if(delta > 0)::BIGINT AS positive_periods, avg(delta) AS mean_delta, {lcb('delta')} AS period_delta_lcb FROM fam_period GROUP BY 1""")


@query("m11_multiplicity_families", f"""SELECT model_family, n_periods, positive_periods, {r('mean_delta')} AS mean_delta, {r('period_delta_lcb')} AS period_delta_lcb FROM fam_rows""")
def m11(spark, sf):
    return rounded(SL.multiplicity(cells(spark, sf, ALL), pooled=False)[0])


@query("m11_multiplicity_summary", f"""SELECT {r('min(period_delta_lcb)')} AS min_family_lcb, {r('median(period_delta_lcb)')} AS median_family_lcb, {r('max(mean_delta)')} AS max_family_mean,
  any_value(pbo) AS pbo, any_value(n_combinations) AS n_combinations, any_value(n_trials) AS n_trials, any_value(n_blocks) AS n_blocks, any_value(is_block_count) AS is_block_count,
  any_value(os_block_count) AS os_block_count, any_value(is_symmetric) AS is_symmetric, any_value(median_logit) AS median_logit FROM fam_rows, pbo_one""")
def m11s(spark, sf):
    out = SL.multiplicity(cells(spark, sf, ALL), pooled=False)[1]
    return rounded(_long(out, "n_trials", "n_blocks", "is_block_count", "os_block_count"))


@query("m12_row_pooled_multiplicity", f"""SELECT model_family, n_periods, positive_periods, {r('row_pooled_delta')} AS mean_delta, {r('period_delta_lcb')} AS period_delta_lcb FROM fam_rows JOIN m6_rows USING (model_family)""")
def m12(spark, sf):
    return rounded(SL.multiplicity(cells(spark, sf, ALL), pooled=True)[0].select("model_family", "n_periods", "positive_periods", "mean_delta", "period_delta_lcb"))


@query("m12_row_pooled_multiplicity_summary", f"""SELECT {r('min(period_delta_lcb)')} AS min_family_lcb, {r('median(period_delta_lcb)')} AS median_family_lcb, {r('max(row_pooled_delta)')} AS max_family_mean,
  any_value(pbo) AS pbo, any_value(n_combinations) AS n_combinations, any_value(n_trials) AS n_trials, any_value(n_blocks) AS n_blocks, any_value(is_block_count) AS is_block_count,
  any_value(os_block_count) AS os_block_count, any_value(is_symmetric) AS is_symmetric, any_value(median_logit) AS median_logit FROM fam_rows JOIN m6_rows USING (model_family), pbo_one""")
def m12s(spark, sf):
    out = SL.multiplicity(cells(spark, sf, ALL), pooled=True)[1]
    return rounded(_long(out, "n_trials", "n_blocks", "is_block_count", "os_block_count"))


# One family has no rows in one period.
@query("m11_roster_gaps", f"""WITH c AS (SELECT DISTINCT model_family, period_id FROM cells_all WHERE NOT (model_family = '{P.PRIMARY}' AND period_id = 'wf_1997'))
  SELECT f.model_family, p.period_id FROM (SELECT DISTINCT model_family FROM c) f, (SELECT DISTINCT period_id FROM c) p EXCEPT SELECT model_family, period_id FROM c""")
def m11g(spark, sf):
    c = cells(spark, sf, ALL)
    return SL.roster_gaps(c.filter(~((F.col("model_family") == P.PRIMARY) & (F.col("period_id") == "wf_1997"))))


@query("m13_seed_mean_points", f"""SELECT a.activity_tercile, {r('a.delta_vs_dummy * 100')} AS delta_points, {r('b.d * 100')} AS check_points, abs(a.delta_vs_dummy - b.d) <= 1e-9 AS reconciled
  FROM m4_rows a JOIN (SELECT activity_tercile, avg({delta()}) AS d FROM terc_seed GROUP BY 1) b USING (activity_tercile) WHERE a.seed = 'seed_mean'""")
def m13(spark, sf):
    """Seed-mean points from the block path against a second path straight from the rows."""
    c = cells(spark, sf)
    a = SL.guarded_terciles(c).filter("seed = 'seed_mean'").select("activity_tercile", F.col("delta_vs_dummy").alias("d"))
    rows = P.scored(spark, sf)
    t = J.attach_day_column(rows, SL.activity_terciles(rows), "activity_tercile").withColumn(
        "activity_tercile", F.explode(F.array(F.lit("all"), F.col("activity_tercile"))))
    b = t.groupBy("activity_tercile", "seed").agg(*C.row_sums()).groupBy("activity_tercile").agg(F.avg(C.delta_f1()).alias("x"))
    return rounded(a.join(b, "activity_tercile").select("activity_tercile", (F.col("d") * 100).alias("delta_points"), (F.col("x") * 100).alias("check_points"),
                                                        (F.abs(F.col("d") - F.col("x")) <= 1e-9).alias("reconciled")))


cte("m14_again", f"""SELECT variant, avg({delta()}) AS d, sum(n)::BIGINT AS n FROM (SELECT variant, seed, count(*) AS n, sum(y_true) AS p, sum(y_pred) AS pp, sum(y_true * y_pred) AS tp, sum(b) AS bp, sum(y_true * b) AS btp FROM
  (SELECT v.variant, seed, y_true, y_pred, CASE WHEN v.variant = 'planted' AND ticker = 'T1' THEN 1 - base_pred ELSE base_pred END AS b FROM scored_one, (SELECT unnest(['as_is', 'planted']) AS variant) v) GROUP BY 1, 2) GROUP BY 1""")


@query("m14_recompute_self_check", f"""SELECT variant, {r('row_pooled_delta')} AS row_pooled_delta, {r('d')} AS recomputed_delta, abs(row_pooled_delta - d) <= 1e-9 AS identical, n AS candidate_rows, (SELECT count(*) FROM scored_one)::BIGINT AS baseline_rows
  FROM m6_rows, m14_again WHERE model_family = '{P.PRIMARY}'""")
def m14(spark, sf):
    """Row-pooled delta from block counts against a recomputation from two joined dumps: the stored one, and one with flipped rows."""
    c, base = cells(spark, sf), P.baseline_dump(spark, sf)
    pooled = materialise(SL.row_pooled(c, []), "pooled")
    n = base.agg(F.count("*").alias("baseline_rows"))
    flip = F.when(F.col("ticker") == "T1", 1 - F.col("y_pred")).otherwise(F.col("y_pred"))
    both = base.select("seed", "sample_id", "y_true", F.col("y_pred").alias("as_is"), flip.alias("planted"))
    j = J.align_baselines(P.scored(spark, sf).drop("base_pred"), both, ["seed", "sample_id"], ["as_is", "planted"])  # both dumps ride on one join
    again = j.groupBy("variant", "seed").agg(*C.row_sums()).groupBy("variant").agg(F.avg(C.delta_f1()).alias("recomputed_delta"), F.sum("n").alias("candidate_rows"))
    out = again.crossJoin(pooled).crossJoin(n)  # one row each
    return rounded(out.select("variant", "row_pooled_delta", "recomputed_delta", (F.abs(F.col("row_pooled_delta") - F.col("recomputed_delta")) <= 1e-9).alias("identical"),
                              "candidate_rows", "baseline_rows"))
