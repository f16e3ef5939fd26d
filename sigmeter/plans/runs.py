"""Staged runs: each reads tables, composes operators and writes contract-checked tables.

A run is idempotent: it overwrites its own outputs (or its own partitions), so an interrupted
run is repeated, not repaired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..operators import (baselines as BL, calibration as CAL, features as FT, folds as FD, guards as G, labels as L,
                         models as M, ranks as R, readouts as RO, resample as RS, selective as SEL, slices as SL, windows as WN)
from ..operators.bars import SplitBoundaries, assign_split, keep_open_splits, resample
from ..session import materialise
from ..sources.tables import write_table


def label_freeze(minutes: DataFrame, out: str, policy: L.LabelPolicy, splits: SplitBoundaries,
                 session: tuple[int, int] | None = (570, 960)) -> None:
    """Raw minutes -> session bars -> open splits -> event index and validity summary."""
    bars = keep_open_splits(assign_split(resample(minutes, policy.bar_minutes, session), splits))
    labelled = materialise(L.direction_labels(bars, policy, splits), "labelled")
    write_table(L.event_index(labelled), f"{out}/event_index", schema.EVENT_INDEX, ["split"], ["ticker", "target_timestamp"])
    write_table(L.validity_summary(labelled), f"{out}/label_validity")


def model_inputs(bars: DataFrame, events: DataFrame, out: str, names: list[str], width: int, feature_set: str,
                 n_folds: int) -> None:
    """Features, windows and train-inner folds, written once for every later fit."""
    train = G.require_rows(G.valid_events(events, "train"), "train events")
    usable = events.filter(F.col("valid_label") & F.col("split").isin("train", "validation"))
    write_table(WN.window_dataset(FT.add_features(bars), usable, names, width, feature_set), f"{out}/windows", partition_by=["split"])
    write_table(FD.train_inner_folds(train, n_folds), f"{out}/folds")


def walkforward(windows: DataFrame, periods: list[tuple[str, str, str]], profiles: list[M.Profile], seeds: list[int], out: str,
                n_features: int, width: int, completed: DataFrame | None = None, hook: M.FitFunction | None = None) -> None:
    """Refit on the past and score each period once; finished (period, profile, seed) units are skipped.

    A unit that fails gets a ledger row with its error and is tried again by the next run.
    """
    spark = windows.sparkSession
    plan = [(p, pr.family, pr.profile_id, s) for p, _, _ in periods for pr in profiles for s in seeds]
    keys = ["period_id", "model_family", "hpo_profile_id", "seed"]
    todo = spark.createDataFrame(plan, "period_id string, model_family string, hpo_profile_id string, seed int")
    if completed is not None:
        todo = G.pending_units(todo, completed, keys)
    left = {tuple(r) for r in todo.collect()}  # the configured roster
    bounds = {p: (a, b) for p, a, b in periods}
    units = [{"period_id": p, "profile": pr, "seed": s} for p, _, _ in periods for pr in profiles for s in seeds
             if (p, pr.family, pr.profile_id, s) in left]
    if not units:
        return

    def rows_of(u):
        a, b = bounds[u["period_id"]]
        day = F.col("trading_day")
        return windows.filter(day < a), windows.filter((day >= a) & (day < b))

    trials = M.run_trials(units, rows_of, hook or M.fit_and_score(n_features, width))
    # One partition per unit: a resumed run adds its units and leaves finished ones as they are.
    if trials.preds is not None:
        write_table(trials.preds, f"{out}/predictions", partition_by=keys)
    if completed is None and trials.preds is None:
        write_table(M.failures_of(spark, trials.failures, keys), f"{out}/ledger")
        return
    kinds = dict(todo.dtypes)
    done = spark.read.parquet(f"{out}/predictions").withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
    ledger = M.ledger_of(done, keys).withColumn("error", F.lit(None).cast("string"))
    if trials.failures:
        ledger = ledger.unionByName(M.failures_of(spark, trials.failures, keys, ledger))
    write_table(ledger, f"{out}/ledger")


def diagnostics(dump: DataFrame, out: str, seeds: tuple[int, ...], holdout: str, n_boot: int = 1000, n_perm: int = 200) -> None:
    """Gate a dump (with ``base_pred``), then calibration, selective, bootstrap and shuffle tables."""
    G.gate_dump(dump.withColumns({"candidate_role": F.lit("primary"), "scope": F.lit("validation_only")}), seeds, holdout)
    summary, bins = CAL.calibration_frames(dump, [5, 10, 15], ("p_up", "equal_mass", 10))
    write_table(summary, f"{out}/calibration_summary")
    write_table(bins, f"{out}/reliability_bins")
    ranked = R.confidence_rank(SEL.with_confidence(dump, ["seed"]), ["seed"])
    write_table(SEL.selective_grid(ranked, ["seed"]), f"{out}/risk_coverage_grid")
    write_table(R.selective_summary(ranked, ["seed"]), f"{out}/selective_summary")
    cells = materialise(RO.block_cells(dump, ["seed"]), "block-cells")
    write_table(RS.minimum_detectable_effect(RS.block_bootstrap(cells, ["seed"], n_boot)), f"{out}/bootstrap")
    write_table(RS.label_shuffle(cells, ["seed"], n_perm), f"{out}/label_shuffle")
    write_table(RS.time_reverse(dump, ["seed"]), f"{out}/time_reverse")
    write_table(SL.guarded_terciles(cells), f"{out}/tercile_map")
    write_table(BL.score_registry(dump, ["seed"]), f"{out}/baselines")
