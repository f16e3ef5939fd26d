"""Selection and decision rules: small final steps over readout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import ratio
from . import micro as MI


def ranked(df: DataFrame, by: list[str], within: list[str], tie: list[str], out: str = "rank") -> DataFrame:
    """Descending rank on ``by`` (nulls last), ties by ``tie`` ascending."""
    order = [F.col(c).desc_nulls_last() for c in by] + [F.col(c).asc() for c in tie]
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


SCREEN_ORDER = ["median_family_lcb", "min_family_lcb", "best_family_lcb", "median_mean_delta", "n_samples_total"]


def select_candidates(screening: DataFrame, top: int = 2, min_tickers: int = 3, min_families: int = 1) -> DataFrame:
    ok = ((F.col("median_mean_delta") > 0) & (F.col("positive_ticker_count") >= min_tickers)
          & (F.col("positive_family_count") >= min_families))
    r = ranked(screening.withColumn("_ok", F.coalesce(ok, F.lit(False))), ["_ok"] + SCREEN_ORDER, [], ["candidate_id"], "_rk")
    any_ok = F.max("_ok").over(Window.partitionBy())
    chosen = F.col("_ok") & (F.col("_rk") <= top)
    reason = (F.when(~any_ok, "failed_stage02_eligibility_rule").when(chosen, "selected_train_inner_probe_signal")
              .otherwise("screened_not_selected"))
    return r.select("candidate_id", chosen.alias("selected_for_stage02"), reason.alias("selection_reason"))


def best_family(fam: DataFrame, keys: list[str]) -> DataFrame:
    low = F.lit(float("-inf"))
    key = F.struct(F.coalesce("lcb_delta", low), F.coalesce("mean_delta", low), "model_family")
    return fam.groupBy(*keys).agg(F.max_by("model_family", key).alias("best_family"), F.max_by("lcb_delta", key).alias("lcb_delta"))


HPO_ORDER = ["lcb_delta_vs_dummy", "mean_delta_vs_dummy", "mean_macro_f1", "min_positive_ticker_count"]
HPO_KEYS = ["candidate_id", "model_family", "hpo_profile_id"]


def eligible_profiles(summary: DataFrame, min_tickers: int) -> DataFrame:
    return summary.filter((F.col("completed_rows") == F.col("expected_rows")) & (F.col("mean_delta_vs_dummy") > 0)
                          & (F.col("mean_delta_vs_majority") > 0) & (F.col("min_positive_ticker_count") >= min_tickers))


def primary_and_fallback(summary: DataFrame, min_tickers: int, family_cap: int = 1) -> DataFrame:
    """First two picks: candidate winners first, then every eligible profile, at most
    ``family_cap`` per family (0 for no cap). The roster is a configured grid, and two picks need
    only the primary and the best row the cap still allows."""
    e = ranked(eligible_profiles(summary, min_tickers), HPO_ORDER, [], HPO_KEYS, "_r")
    e = e.withColumn("_first", F.row_number().over(Window.partitionBy("candidate_id").orderBy("_r")) == 1)
    one = Window.partitionBy()
    e = e.withColumn("_primary", F.col("_r") == F.min("_r").over(one))
    fam = F.max(F.when(F.col("_primary"), F.col("model_family"))).over(one)
    allowed = ~F.col("_primary") & ((F.col("model_family") != fam) if family_cap == 1 else F.lit(True))
    e = e.withColumn("_second", F.when(allowed, F.struct((~F.col("_first")).alias("late"), F.col("_r").alias("r"))))
    e = e.withColumn("_fallback", F.col("_second").eqNullSafe(F.min("_second").over(one)) & F.col("_second").isNotNull())
    role = F.when(F.col("_primary"), "primary").when(F.col("_fallback"), "fallback")
    return e.withColumn("selected_role", role).filter(role.isNotNull()).select("selected_role", *HPO_KEYS, *HPO_ORDER)


# Fixed decision and block-reason names of the selection gate, in the order in which they are tried.
GATE = (
    ("do_not_start_stage03_no_hpo_summary_rows", "no_hpo_summary_rows"),
    ("do_not_start_stage03_hpo_trials_incomplete", "one_or_more_hpo_trials_failed_or_skipped"),
    ("do_not_start_stage03_no_hpo_candidate_cleared_selection_gates", "no_hpo_candidate_cleared_baseline_or_ticker_robustness_gates"),
    ("do_not_start_stage03_missing_primary_or_fallback_candidate", "stage02_requires_primary_and_fallback_candidates"),
)
READY = "ready_for_stage03_frozen_train_inner_hpo_candidates"


def selection_bundle(summary: DataFrame, ledger: DataFrame, min_tickers: int, family_cap: int = 1, require_completed: bool = True) -> DataFrame:
    """One row: whether the next stage may start, the decision, why it is blocked, and the two picks.

    The first fault counts: no summary, an unfinished trial (where all must be finished), nothing eligible, or no
    second pick. Picks are named where the gate got as far as choosing them. Every input is a roster, and each part is one row.
    """
    n = summary.agg(F.count("*").alias("_summary"))
    open_ = ledger.agg(F.count_if(~F.col("fit_status").eqNullSafe("completed")).alias("_open"))
    able = eligible_profiles(summary, min_tickers).agg(F.count("*").alias("_able"))
    picks = primary_and_fallback(summary, min_tickers, family_cap)
    name = F.concat_ws("|", *HPO_KEYS)
    two = picks.agg(*[F.max(F.when(F.col("selected_role") == role, name)).alias(role) for role in ("primary", "fallback")])
    x = n.crossJoin(open_).crossJoin(able).crossJoin(two)  # one row each
    faults = (F.col("_summary") == 0, F.lit(require_completed) & (F.col("_open") > 0), F.col("_able") == 0, F.col("primary").isNull() | F.col("fallback").isNull())
    decision, reason, chosen = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), False)
    for i, (fault, (d, r)) in enumerate(zip(faults, GATE)):
        decision, reason, chosen = decision.when(fault, d), reason.when(fault, r), chosen.when(fault, i == 3)
    decision, reason, chosen = decision.otherwise(READY), reason.otherwise(""), chosen.otherwise(True)
    return x.select((decision == READY).alias("ready_for_next_stage"), decision.alias("decision"), reason.alias("block_reason"),
                    F.when(chosen, F.col("primary")).alias("primary"), F.when(chosen, F.col("fallback")).alias("fallback"))


def best_profile_per_family(summary: DataFrame) -> DataFrame:
    return ranked(summary, HPO_ORDER[:3], ["model_family"], ["candidate_id", "hpo_profile_id"], "_r").filter("_r = 1").drop("_r")


def mark_selected(ledger: DataFrame, picks: DataFrame) -> DataFrame:
    return ledger.join(picks.select("selected_role", *HPO_KEYS), HPO_KEYS, "left").withColumn(
        "selected_role", F.coalesce("selected_role", F.lit("")))


def validation_criteria(per_seed: DataFrame, per_ticker: DataFrame, min_positive: int = 3) -> DataFrame:
    """Seed-mean deltas above both baselines and enough tickers positive on seed average."""
    a = per_seed.agg(F.count("*").alias("n_completed_seeds"), F.avg("macro_f1").alias("mean_macro_f1"),
                     F.avg("delta_vs_dummy").alias("mean_delta_vs_dummy"), F.avg("delta_vs_majority").alias("mean_delta_vs_majority"))
    t = per_ticker.groupBy("ticker").agg(F.avg("delta_vs_dummy").alias("_d")).agg(F.count_if(F.col("_d") > 0).alias("positive_ticker_count"))
    x = a.crossJoin(t).withColumns({  # one row each
        "delta_vs_stratified_dummy_met": F.col("mean_delta_vs_dummy") > 0, "delta_vs_majority_met": F.col("mean_delta_vs_majority") > 0,
        "ticker_floor_met": F.col("positive_ticker_count") >= min_positive})
    met = F.col("delta_vs_stratified_dummy_met") & F.col("delta_vs_majority_met") & F.col("ticker_floor_met")
    return x.withColumn("decision", F.when(met, "met_predeclared_validation_readout_criteria")
                        .otherwise("did_not_meet_predeclared_validation_readout_criteria"))


def walkforward_criteria(row_pooled: DataFrame, equal_weight: DataFrame, min_periods: int = 2) -> DataFrame:
    """The row-pooled delta binds when there is one, else the equal-weight companion, and says so."""
    x = equal_weight.crossJoin(row_pooled)  # one row each
    have = F.col("row_pooled_delta").isNotNull()
    pooled = F.coalesce("row_pooled_delta", "equal_weight_delta")
    c1, c2 = F.col("positive_period_count") >= min_periods, pooled > 0
    return x.select("positive_period_count", pooled.alias("pooled_delta"), F.when(have, "row_pooled").otherwise("equal_weight").alias("pooled_delta_estimand"),
                    "row_pooled_delta", "equal_weight_delta", c1.alias("positive_period_count_met"), c2.alias("pooled_delta_met"),
                    F.when(c1 & c2, "met_predeclared_guarded_stability_criteria").otherwise("did_not_meet_predeclared_guarded_stability_criteria").alias("decision"))


def null_band(ledger: DataFrame, where: Column, expected_rows: int) -> DataFrame:
    """Largest |delta| over the reference rows; incomplete references give no band."""
    d = F.col("delta_vs_dummy")
    g = ledger.filter(where).agg(F.count("*").alias("n_rows"), F.count_if(F.col("fit_status") == "completed").alias("_c"),
                                 F.max(F.abs(d)).alias("_m"), F.avg(d).alias("mean_delta"))
    whole = (F.col("n_rows") == expected_rows) & (F.col("_c") == F.col("n_rows"))
    return g.select("n_rows", whole.alias("complete"), F.when(whole, F.col("_m")).alias("max_abs_delta"), "mean_delta")


def signal_flags(agg: DataFrame, min_tickers: int) -> DataFrame:
    mean = F.coalesce(F.col("mean_delta") > 0, F.lit(False))
    low = F.coalesce(F.col("lcb_delta") > 0, F.lit(False))
    tick = F.coalesce(F.col("min_positive_ticker_count") >= min_tickers, F.lit(False))
    return agg.withColumns({"flag_mean_positive": mean, "flag_lcb_positive": low, "flag_ticker_floor_met": tick, "flags_signal": mean & low & tick})


def planted_criteria(arms: DataFrame, null_band_abs: float, min_tickers: int, detection_from: float) -> DataFrame:
    """P1 null honesty, P2 monotone response, P3 detection over arms keyed by ``strength``."""
    a = signal_flags(arms, min_tickers).withColumn("_prev", F.lag("mean_delta").over(Window.orderBy("strength")))  # a few arms
    null = F.col("strength") == 0
    p1 = F.bool_and(~null | (~F.col("flag_lcb_positive") & (F.abs("mean_delta") <= null_band_abs) & ~F.col("flags_signal")))
    p2 = F.bool_and(F.col("mean_delta").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") < F.col("mean_delta"))))
    p3 = F.bool_and((F.col("strength") < detection_from) | F.col("flags_signal"))
    g = a.agg(p1.alias("p1_pass"), p2.alias("p2_monotone_pass"), p3.alias("p3_detection_pass"), F.bool_or(null & F.col("flags_signal")).alias("null_flags"),
              F.bool_or(F.col("completed_rows") < F.col("expected_rows")).alias("incomplete"))
    outcome = (F.when(F.col("incomplete"), "incomplete_run_fix_and_rerun").when(F.col("null_flags") & ~F.col("p3_detection_pass"), "fail_manufacturing_and_insensitive")
               .when(F.col("null_flags"), "fail_manufacturing").when(~F.col("p3_detection_pass"), "fail_insensitive")
               .when(~F.col("p2_monotone_pass") | ~F.col("p1_pass"), "fail_nonmonotone_or_null_band").otherwise("pass"))
    return g.withColumn("overall_outcome", outcome)


def band_horizon_reading(cells: DataFrame, frozen_k: int, frozen_band: float) -> DataFrame:
    """Sign stability along the band axis and the horizon axis; incomplete cells void the reading."""
    m = F.col("mean_delta")
    c = cells.withColumn("_s", F.when(m > 0, "positive").when(m < 0, "negative").when(m == 0, "zero").otherwise("undefined"))

    def axis(on: Column) -> tuple[Column, Column]:
        s = F.when(on, F.col("_s"))
        defined = F.coalesce(F.bool_and(s.isin("positive", "negative")), F.lit(True))
        return defined, defined & (F.count_distinct(s) == 1)

    bd, bs = axis(F.col("horizon_k") == frozen_k)
    hd, hs = axis(F.col("no_trade_band_bps") == frozen_band)
    g = c.agg(F.bool_or((F.col("completed_rows") < F.col("expected_rows")) | (F.col("expected_rows") == 0)).alias("_inc"), bd.alias("_bd"), hd.alias("_hd"),
              bs.alias("band_axis_sign_stable"), hs.alias("horizon_axis_sign_stable"))
    b, h = F.col("band_axis_sign_stable"), F.col("horizon_axis_sign_stable")
    outcome = (F.when(F.col("_inc"), "incomplete_run_fix_and_rerun").when(~F.col("_bd") | ~F.col("_hd"), "sign_undefined_on_an_axis_reported_descriptively")
               .when(b & h, "not_knife_edge_sign_stable_both_axes").when(~b & ~h, "sign_flip_on_both_axes_limitation_strengthened")
               .when(~b, "sign_flip_on_band_axis_limitation_strengthened").otherwise("sign_flip_on_horizon_axis_limitation_strengthened"))
    return g.select("band_axis_sign_stable", "horizon_axis_sign_stable", outcome.alias("overall_outcome"))


def embargo_reading(ledger: DataFrame, shrinkage: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(per seed, outcome): margins with and without the first evaluation day."""
    ok = F.col("fit_status") == "completed"

    def of(v: str) -> list[Column]:
        on = F.col("variant_id") == v
        return [F.avg(F.when(on & ok, F.col("delta_vs_dummy"))).alias(f"{v}_margin"), F.count_if(on).alias(f"{v}_expected_rows"),
                F.count_if(on & ok).alias(f"{v}_completed_rows")]

    s = ledger.groupBy("seed").agg(*of("no_embargo"), *of("embargo_1day"))
    base, emb = F.col("no_embargo_margin"), F.col("embargo_1day_margin")
    app = F.coalesce(base > 0, F.lit(False))
    s = s.withColumns({"rule_applicable": app, "retained_margin_fraction": F.when(app, ratio(emb, base)),
                       "materially_smaller": F.when(app, F.coalesce(emb < shrinkage * base, F.lit(False)))})
    inc = F.lit(False)
    for v in ("no_embargo", "embargo_1day"):
        inc = inc | (F.col(f"{v}_expected_rows") == 0) | (F.col(f"{v}_completed_rows") < F.col(f"{v}_expected_rows"))
    g = s.agg(F.bool_or(inc).alias("i"), F.bool_and("rule_applicable").alias("a"), F.bool_and("materially_smaller").alias("all_s"), F.bool_or("materially_smaller").alias("any_s"))
    out = (F.when(F.col("i"), "incomplete_run_fix_and_rerun").when(~F.col("a"), "baseline_margin_not_positive_rule_inapplicable")
           .when(F.col("all_s"), "materially_smaller_cross_day_dependence_inflation_reported")
           .when(~F.col("any_s"), "roughly_unchanged_limitation_bounded_not_removed").otherwise("mixed_across_seeds_inconclusive"))
    return s, g.select(out.alias("overall_outcome"))


def halfspread_verdict(readout: DataFrame, verdict_min_rows: int, report_min_rows: int = 200) -> DataFrame:
    """Bounce verdict from the low-tercile partition readout (a few dozen rows)."""
    per, mean = F.col("seed") != "seed_mean", F.col("seed") == "seed_mean"
    d, lo, hi = F.col("delta_vs_dummy"), F.col("boot_delta_lcb"), F.col("boot_delta_ucb")

    def every(cell: str, cond: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(per & (F.col("cell") == cell), F.coalesce(cond, F.lit(False)))), F.lit(False))

    aggs = {}
    for name, cell in (("fine", MI.LE_HALF), ("coarse", MI.LE_1), ("high", MI.GT_1)):
        aggs[f"{name}_occ"] = every(cell, F.col("n_rows") >= verdict_min_rows)
        aggs[f"{name}_null"] = every(cell, (d <= 0) | ((lo <= 0) & (hi >= 0)))
        aggs[f"{name}_pos"] = every(cell, (d > 0) & (lo > 0))
        aggs[f"{name}_agree"] = every(cell, d > 0) | every(cell, d <= 0)
        aggs[f"{name}_mean"] = F.avg(F.when(per & (F.col("cell") == cell), d))
    aggs["all_delta"] = F.max(F.when(mean & (F.col("cell") == "all"), d))
    pos = F.array_position(F.array(*[F.lit(c) for c in MI.FINE]), F.col("cell"))
    usable = mean & F.col("cell").isin(*MI.FINE) & (F.col("n_rows") >= 2 * report_min_rows) & d.isNotNull()
    fine = F.transform(F.array_sort(F.collect_list(F.when(usable, F.struct(pos.alias("i"), d.alias("d"))))), lambda s: s["d"])
    aggs["fine_deltas"] = fine  # at most four values
    g = readout.agg(*[v.alias(k) for k, v in aggs.items()])
    drops = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("fine_deltas") - 1)),
                            lambda i: F.get(F.col("fine_deltas"), i) < F.get(F.col("fine_deltas"), i - 1)))
    mono = (F.size("fine_deltas") >= 3) & (drops <= 1)

    def low(k: str) -> Column:
        return F.when(F.col("fine_occ"), F.col(f"fine_{k}")).otherwise(F.col(f"coarse_{k}"))

    occ = (F.col("fine_occ") | F.col("coarse_occ")) & F.col("high_occ")
    bounce = low("null") & F.col("high_pos") & mono
    real = low("pos") & F.coalesce((F.col("all_delta") > 0) & (low("mean") >= 0.5 * F.col("all_delta")), F.lit(False))
    verdict = (F.when(~occ | ~low("agree"), "inconclusive").when(bounce, "consistent_with_bounce_domination")
               .when(real, "not_explainable_by_bounce_alone").otherwise("inconclusive"))
    reason = (F.when(~occ, "anchor_occupancy_below_verdict_min_rows").when(~low("agree"), "per_seed_sign_disagreement_on_low_anchor")
              .when(bounce, "low_anchor_null_high_anchor_positive_monotone").when(real, "low_anchor_positive_at_comparable_size")
              .otherwise("pattern_matches_neither_predeclared_outcome"))
    return g.select(F.when(F.col("fine_occ"), MI.LE_HALF).otherwise(MI.LE_1).alias("low_anchor_used"), occ.alias("anchor_occupancy_ok"),
                    mono.alias("monotone_ok"), verdict.alias("verdict"), reason.alias("reason"))
