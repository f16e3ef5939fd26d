"""Model runs on the tape's windows. Fits have no SQL form; their inputs and tables do."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..operators import folds as FD, many_fits as MF, models as M, windows as WN
from ..session import materialise
from ..sources import predictions as P
from .base import cte, query, r, rounded
from .ingest import N_FOLDS, WIN_FEATS, WINDOW, featured, train_events, windows

NF = len(WIN_FEATS)
PROFILES = {
    "logit": M.Profile("logit", "l2", {}),
    "trees": M.Profile("trees", "d3", {"iters": 4}),
    "trend_linear": M.Profile("trend_linear", "k3", {"kernels": (3,)}),
    "multi_trend_linear": M.Profile("multi_trend_linear", "k35", {"kernels": (3, 5)}),
    "last_step_mlp": M.Profile("last_step_mlp", "h8", {}),
    "last_step_trees": M.Profile("last_step_trees", "d3", {"iters": 4}),
}
KEYS = ["model_family", "hpo_profile_id", "seed"]


def window_rows(spark, sf):
    """Train and validation windows, written once: every fit of a run reads this table."""
    return materialise(windows(spark, sf, split=None), "windows")


def readout(spark, sf, names, seeds=(101,)):
    """Fit on train, score validation once per profile and seed."""
    w = window_rows(spark, sf)
    units = [{"profile": PROFILES[n], "seed": s} for n in names for s in seeds]
    return M.run_units(units, lambda u: (w.filter("split = 'train'"), w.filter("split = 'validation'")), M.fit_and_score(NF, WINDOW))


def _probe(code: str, family: str) -> None:
    @query(f"{code}_{family}")
    def one(spark, sf):
        return rounded(M.ledger_of(readout(spark, sf, [family]), KEYS), 6)


for _c, _f in (("g6", "logit"), ("g7", "trees"), ("g8", "trend_linear"), ("g9", "multi_trend_linear"), ("g10", "last_step_mlp"),
               ("g11", "last_step_trees")):
    _probe(_c, _f)


@query("g12_class_weights", f"""SELECT label, {r('(SELECT count(*) FROM windows5)::DOUBLE / (2 * count(*))')} AS weight FROM windows5 GROUP BY 1""")
def g12(spark, sf):
    return rounded(M.class_weights(windows(spark, sf)))


cte("feat_pos", """SELECT *, row_number() OVER (PARTITION BY ticker, trading_day ORDER BY "timestamp") AS bar_no FROM features""")


@query("g13_feature_statistics", f"""WITH c AS (SELECT unnest([0, 1, 2]) AS feature_index, unnest([f.log_return::FLOAT::DOUBLE, f.high_low_range::FLOAT::DOUBLE, f.time_of_day_sin::FLOAT::DOUBLE]) AS v
    FROM windows5 w JOIN feat_pos f ON f.ticker = w.ticker AND f.trading_day = strftime(w.target_timestamp, '%Y-%m-%d') AND f.bar_no > w.window_start_position AND f.bar_no <= w.window_end_position_exclusive)
  SELECT feature_index, {r('avg(v)', 6)} AS mean, {r('stddev_pop(v)', 6)} AS std, count(*)::BIGINT AS n_cells FROM c GROUP BY 1""")
def g13(spark, sf):
    return rounded(M.feature_statistics(windows(spark, sf), NF), 6)


@query("g8_trend_inputs", f"""WITH s AS (SELECT w.sample_id, f.log_return::FLOAT::DOUBLE AS x, f.bar_no - w.window_start_position AS i FROM windows5 w JOIN feat_pos f ON f.ticker = w.ticker
    AND f.trading_day = strftime(w.target_timestamp, '%Y-%m-%d') AND f.bar_no > w.window_start_position AND f.bar_no <= w.window_end_position_exclusive)
  SELECT a.sample_id, {r('sum(b.x) / 3', 5)} AS last_trend, {r('max(a.x) - sum(b.x) / 3', 5)} AS last_residual FROM (SELECT * FROM s WHERE i = 5) a, (SELECT unnest([4, 5, 5]) AS j) o JOIN s b ON b.sample_id = a.sample_id AND b.i = o.j GROUP BY 1""")
def g8t(spark, sf):
    """Trend and residual of the last bar's first feature (replicated right edge)."""
    x = M.trend_and_residual(F.col("features"), NF, WINDOW, [3])
    at = NF * (WINDOW - 1)
    return windows(spark, sf).select("sample_id", F.round(x[at], 5).alias("last_trend"), F.round(x[NF * WINDOW + at], 5).alias("last_residual"))


def grouped(names, seeds, groups: dict[str, dict]) -> list[dict]:
    """Units of profiles x seeds x groups; ``groups`` maps a fit group to its labels."""
    return [{"profile": GRID[n], "seed": s, "fit_group": g, **labels} for n in names for s in seeds for g, labels in groups.items()]


def fold_groups():
    return {f"fold_{i}": {"fold_id": f"fold_{i}"} for i in range(N_FOLDS)}


def candidate_run(spark, sf, names, seeds, cols, width, name, folds):
    """Profiles x folds x seeds of one feature set and window size on the train-inner folds."""
    ev = train_events(spark, sf)
    rows = FD.fold_rows(WN.window_dataset(featured(spark, sf), ev, cols, width, name), folds)
    data = MF.prepare(materialise(rows.withColumn("fit_group", F.col("fold_id")), "candidate"), len(cols))
    return MF.run_roster(data, grouped(names, seeds, fold_groups()), len(cols), width)


GRID = PROFILES | {
    "logit_strong": M.Profile("logit", "l2_strong", {"reg": 0.1}),
    "trees_shallow": M.Profile("trees", "d2", {"iters": 4, "depth": 2}),
    "last_step_trees_shallow": M.Profile("last_step_trees", "d2", {"iters": 4, "depth": 2}),
}
FEATURE_SETS = {"returns": ["log_return", "high_low_range"], "clock": ["time_of_day_sin", "time_of_day_cos"], "all": ["log_return", "high_low_range", "time_of_day_sin", "time_of_day_cos"]}
WIDTHS = (3, 5)


CANDIDATES_AT_ONCE = 3


def candidate_ledger(spark, sf, names, candidates):
    """One ledger over candidates (feature set, window size); each candidate's rows are prepared once for all its fits.

    Candidates are a configured roster; a few run side by side, as their small jobs leave cores idle.
    """
    folds = materialise(FD.train_inner_folds(train_events(spark, sf), N_FOLDS), "folds")

    def one(candidate):
        name, width = candidate
        t = candidate_run(spark, sf, names, P.SEEDS, FEATURE_SETS[name], width, name, folds)
        # Written per candidate, so that no plan holds the fits of all.
        return materialise(M.trial_rows(t, KEYS + ["fold_id"], spark).withColumn("candidate_id", F.lit(f"{name}_w{width}")), "trials")

    out = None
    with ThreadPoolExecutor(CANDIDATES_AT_ONCE) as pool:
        for led in pool.map(one, candidates):
            out = led if out is None else out.unionByName(led, allowMissingColumns=True)
    return out


@query("g14_hpo_grid_run")
def g14(spark, sf):
    """Feature sets x window sizes x profiles x folds x seeds in one ledger; a failed fit is a row with its error."""
    return rounded(candidate_ledger(spark, sf, list(GRID), [(n, w) for n in ("returns", "all") for w in WIDTHS]), 6)


@query("g15_probe_screening_run")
def g15(spark, sf):
    """Feature sets x window sizes x probes x seeds on the train-inner folds; a failed fit is a row with its error."""
    return rounded(candidate_ledger(spark, sf, list(PROFILES), [(n, w) for n in FEATURE_SETS for w in WIDTHS]), 6)


PERIODS = [("wf_1", "2024-01-12", "2024-01-17"), ("wf_2", "2024-01-17", "2024-01-22"), ("wf_3", "2024-01-22", "2024-01-27")]


def walkforward(spark, sf, names, seeds):
    """Refit on everything before each period, score the period once."""
    w = window_rows(spark, sf).drop("split")
    bounds = spark.createDataFrame(PERIODS, "period_id string, lo string, hi string")
    rows = w.join(F.broadcast(bounds), F.col("trading_day") < F.col("hi"))  # a fit on an expanding history reads it once per period
    rows = rows.withColumns({"fit_group": F.col("period_id"), "fold_side": F.when(F.col("trading_day") < F.col("lo"), "train").otherwise("eval")})
    data = MF.prepare(materialise(rows, "period-windows"), NF)
    return MF.run_roster(data, grouped(names, seeds, {p: {"period_id": p} for p, _, _ in PERIODS}), NF, WINDOW)


@query("g16_walkforward_refit")
def g16(spark, sf):
    """Every family on every period with every seed."""
    return rounded(M.trial_rows(walkforward(spark, sf, list(PROFILES), P.SEEDS), KEYS + ["period_id"], spark), 6)


@query("g16_walkforward_predictions")
def g16p(spark, sf):
    """The predictions of the refits by period, in dump form."""
    p = walkforward(spark, sf, list(PROFILES), P.SEEDS).preds
    return rounded(p.select("period_id", *KEYS, "sample_id", "ticker", "target_timestamp", "trading_day", "y_true", "p_up", "y_pred", "base_pred"), 6)


@query("g17_frozen_validation_readout")
def g17(spark, sf):
    return rounded(M.ledger_of(readout(spark, sf, ["last_step_trees"], seeds=P.SEEDS), KEYS), 6)


@query("g18_control_ablation_run")
def g18(spark, sf):
    """Linear, trees and the two last-bar controls over folds and seeds."""
    w = window_rows(spark, sf).filter("split = 'train'")
    rows = FD.fold_rows(w, FD.train_inner_folds(train_events(spark, sf), N_FOLDS)).withColumn("fit_group", F.col("fold_id"))
    data = MF.prepare(materialise(rows, "fold-windows"), NF)
    trials = MF.run_roster(data, grouped(["logit", "trees", "last_step_mlp", "last_step_trees"], P.SEEDS, fold_groups()), NF, WINDOW)
    return rounded(M.trial_rows(trials, KEYS + ["fold_id"], spark), 6)


@query("g19_embargo_run")
def g19f(spark, sf):
    """Linear families on every fold; one fit is scored with and without its first evaluation day.

    Scores are counted per day once, so the embargoed variant is the fold's counts minus those of its first day.
    """
    w = window_rows(spark, sf).filter("split = 'train'")
    rows = FD.fold_rows(w, FD.train_inner_folds(train_events(spark, sf), N_FOLDS)).withColumn("fit_group", F.col("fold_id"))
    data = MF.prepare(materialise(rows, "fold-windows"), NF)
    trials = MF.run_roster(data, grouped(["logit", "trend_linear"], P.SEEDS, fold_groups()), NF, WINDOW)
    return rounded(M.embargoed(trials, KEYS + ["fold_id"], spark), 6)


@query("p11_embargo_reading_of_fits")
def p11f(spark, sf):
    """The embargo reading on margins of fitted units, per seed."""
    from ..operators import decide as DE

    t = g19f(spark, sf).filter("model_family = 'logit'")
    return rounded(DE.embargo_reading(t.select("variant_id", "seed", "fold_id", "fit_status", "delta_vs_dummy"))[0], 6)


@query("g20_planted_signal_run")
def g20(spark, sf):
    """Planted arms through the same fits on the train-inner folds: labels replaced, windows untouched; with the sentinels of each fit."""
    from ..operators import planted as PL, readouts as RO, resample as RS
    from .closing import ARMS, PLANT_SEED, ruled
    from .robust import N_PERM, PERM_SEED

    w = window_rows(spark, sf).filter("split = 'train'").drop("label", "split")
    lab = PL.inject(ruled(spark, sf), ARMS, PLANT_SEED).select("sample_id", "arm_id", "label")
    folds = FD.train_inner_folds(train_events(spark, sf), N_FOLDS)
    rows = FD.fold_rows(w.join(lab, "sample_id"), folds).withColumn("fit_group", F.concat_ws("|", "arm_id", "fold_id"))
    groups = {f"{a}|{g}": {**labels, "arm_id": a} for a in ARMS for g, labels in fold_groups().items()}
    data = MF.prepare(materialise(rows, "planted-windows"), NF)
    trials = MF.run_roster(data, grouped(["logit", "trend_linear", "last_step_trees"], P.SEEDS, groups), NF, WINDOW)
    keys = KEYS + ["fold_id", "arm_id"]
    if trials.preds is None:
        return M.trial_rows(trials, keys, spark)
    preds = trials.preds
    sentinels = RS.label_shuffle(RO.block_cells(preds, keys), keys, N_PERM, PERM_SEED).drop("n_rows").join(RS.time_reverse(preds, keys), keys)
    return rounded(M.trial_rows(trials, keys, spark).join(sentinels, keys, "left"), 6)


@query("g21_prediction_dump")
def g21(spark, sf):
    """Per-row predictions of the logit profile in dump form."""
    p = readout(spark, sf, ["logit"])
    return rounded(p.select("model_family", "hpo_profile_id", "seed", "sample_id", "ticker", "target_timestamp", "trading_day", "y_true", "p_up", "y_pred"), 6)
