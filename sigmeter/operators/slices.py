"""Slices, leave-one-out and pooled estimands, all from block counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import confusion as C
from ..functions.scalar import ratio

TERCILES = ("low", "mid", "high")


def activity_terciles(rows: DataFrame) -> DataFrame:
    """Per ticker, days ranked by row count (ties by day) cut at thirds: one row per day.

    The window runs over one row per calendar day of a ticker.
    """
    days = rows.groupBy("ticker", "trading_day").agg(F.count("*").alias("_n"))
    return terciles_of_days(days)


def terciles_of_days(days: DataFrame) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy("ticker").orderBy("_n", "trading_day"))
    nd = F.count("*").over(Window.partitionBy("ticker"))
    cut = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(rk.cast("double") / nd.cast("double") * 3)))
    return days.select("ticker", "trading_day", cut.alias("_c")).select(
        "ticker", "trading_day", F.when(F.col("_c") == 1, "low").when(F.col("_c") == 2, "mid")
        .otherwise("high").alias("activity_tercile"))


def with_terciles(cells: DataFrame) -> DataFrame:
    """Block counts with their day's tercile; the day map comes from the counts themselves."""
    days = cells.groupBy("ticker", "trading_day").agg(F.sum("n").alias("_n"))
    return cells.join(terciles_of_days(days), ["ticker", "trading_day"])


def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the majority label of the warm-up history (tie to 0)."""
    from ..sources import predictions as P

    hist = P.facts(spark, sf_dir).filter(F.col("target_timestamp") < F.lit(P.WARMUP_END).cast("timestamp_ntz"))
    return hist.agg(F.when(F.avg("y_true") > 0.5, 1).otherwise(0).alias("majority_class"))


def complement(cells: DataFrame, within: list[str], slice_keys: list[str]) -> DataFrame:
    """Counts of everything but each slice: totals minus the slice, no anti-join."""
    s = cells.groupBy(*within, *slice_keys).agg(*C.resum())
    w = Window.partitionBy(*within)
    return s.select(*within, *slice_keys, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in C.SUMS])


def axis_cells(cells: DataFrame, axes: dict[str, Column], keep: list[str]) -> DataFrame:
    """Block counts repeated once per slice axis, as (slice_axis, slice_value)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("slice_axis"), c.cast("string").alias("slice_value")) for a, c in axes.items()])
    return cells.withColumn("_x", F.explode(pairs)).select(*keep, "_x.slice_axis", "_x.slice_value", *C.SUMS)


def robustness_slices(cells: DataFrame, axes: dict[str, Column], majority: DataFrame, boot_axes: list[str],
                      loo_axes: list[str], n_boot: int, seed: int) -> DataFrame:
    """Per seed x axis x value: macro-F1, deltas, share of the pooled delta, leave-one-out and
    bootstrap bounds. The seed axis compares each seed with the other seeds' rows."""
    from .resample import block_bootstrap

    long = axis_cells(cells, {**axes, "seed": F.col("seed")}, ["seed", "ticker", "trading_day"])
    # ``cells`` is read for the slices, the totals and the bootstrap: pass a materialised table.
    s = long.groupBy("seed", "slice_axis", "slice_value").agg(*C.resum())
    seeds = cells.groupBy("seed").agg(*C.resum())
    every = Window.partitionBy()
    tot = seeds.select("seed", *[F.col(c).alias("_" + c) for c in C.SUMS],
                       *[F.sum(c).over(every).alias("_g" + c) for c in C.SUMS])
    s = s.join(F.broadcast(tot), "seed").crossJoin(F.broadcast(majority))  # seeds; one row
    is_seed = F.col("slice_axis") == "seed"
    rest = {c: F.when(is_seed, F.col("_g" + c)).otherwise(F.col("_" + c)) - F.col(c) for c in C.SUMS}
    pooled = C.macro_f1("_n", "_p", "_pp", "_tp") - C.base_f1("_n", "_p", "_bp", "_btp")
    loo = C.macro_f1(rest["n"], rest["p"], rest["pp"], rest["tp"]) - C.base_f1(rest["n"], rest["p"], rest["bp"], rest["btp"])
    has = F.col("slice_axis").isin(loo_axes)
    out = s.select(
        "seed", "slice_axis", "slice_value", F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1"),
        (C.macro_f1() - C.constant_f1(F.col("majority_class"))).alias("delta_vs_majority"), C.delta_f1().alias("delta_vs_dummy"),
        F.when((pooled > 0) & ~is_seed, ratio("n", "_n") * C.delta_f1() / pooled).alias("share_of_pooled_positive_delta"),
        F.when(has, loo).alias("loo_pooled_delta"), F.when(has, loo <= 0).alias("loo_sign_flip"))
    boot = block_bootstrap(long.filter(F.col("slice_axis").isin(boot_axes)), ["seed", "slice_axis", "slice_value"], n_boot, seed)
    return out.join(boot.select("seed", "slice_axis", "slice_value", F.col("lcb").alias("bootstrap_delta_lcb"),
                                F.col("ucb").alias("bootstrap_delta_ucb")), ["seed", "slice_axis", "slice_value"], "left")


def failure_slices(counts: DataFrame, minimum_rows: int, top_k: int) -> DataFrame:
    """Worst slices per seed and axis by error rate (ties by value).

    ``counts`` holds (seed, slice_axis, slice_value, n, p, errors). row_number <= k lets Spark
    keep k rows per task before the shuffle.
    """
    pooled = counts.filter(F.col("slice_axis") == F.lit("activity_tercile")).groupBy("seed").agg(
        ratio(F.sum("errors"), F.sum("n")).alias("_pooled"))
    rate = ratio("errors", "n")
    w = Window.partitionBy("seed", "slice_axis").orderBy(F.col("error_rate").desc(), "slice_value")
    top = counts.filter(F.col("n") >= minimum_rows).withColumn("error_rate", rate).withColumn(
        "_rk", F.row_number().over(w)).filter(F.col("_rk") <= top_k)
    return top.join(F.broadcast(pooled), "seed").select(
        "seed", "slice_axis", "slice_value", F.col("n").alias("n_rows"), F.col("errors").alias("error_count"), "error_rate",
        (F.col("error_rate") - F.col("_pooled")).alias("error_rate_lift_vs_seed_pooled"), F.col("p").alias("support_up"),
        (F.col("n") - F.col("p")).alias("support_down"))


def concentration_summary(robustness: DataFrame) -> DataFrame:
    return robustness.filter("loo_sign_flip").groupBy("slice_axis").agg(
        F.array_sort(F.collect_set("slice_value")).alias("flipping_values"))  # a few axis values


def with_seed_mean(rows: DataFrame, keys: list[str], stats: list[str], n_rows: Column) -> DataFrame:
    """Per-seed rows plus their finite mean as seed = 'seed_mean'."""
    mean = rows.groupBy(*keys).agg(n_rows.alias("n_rows"), *[F.avg(c).alias(c) for c in stats]).withColumn("seed", F.lit("seed_mean"))
    return rows.select(*keys, F.col("seed").cast("string").alias("seed"), "n_rows", *stats).unionByName(mean)


def tercile_cells(cells: DataFrame) -> DataFrame:
    """Block counts under their tercile and under 'all'."""
    return with_terciles(cells).withColumn("activity_tercile", F.explode(F.array(F.lit("all"), F.col("activity_tercile"))))


def guarded_terciles(cells: DataFrame, random_prior: float = 0.5) -> DataFrame:
    g = tercile_cells(cells).groupBy("activity_tercile", "seed").agg(*C.resum())
    rows = g.select("activity_tercile", "seed", F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1"), C.accuracy().alias("accuracy"),
                    C.base_f1().alias("dummy_macro_f1"), C.delta_f1().alias("delta_vs_dummy"))
    out = with_seed_mean(rows, ["activity_tercile"], ["macro_f1", "accuracy", "dummy_macro_f1", "delta_vs_dummy"],
                         F.round(F.avg("n_rows")).cast("long"))
    return out.withColumn("below_random_prior", F.col("macro_f1") < random_prior)


def guarded_base_rates(cells: DataFrame) -> DataFrame:
    t = with_terciles(cells)
    pairs = F.array(F.struct(F.lit("period").alias("scope"), F.col("period_id").alias("slice")),
                    F.struct(F.lit("activity_tercile").alias("scope"), F.col("activity_tercile").alias("slice")))
    g = t.withColumn("_x", F.explode(pairs)).select("seed", "_x.*", *C.SUMS).groupBy("scope", "slice", "seed").agg(*C.resum())
    rows = g.select("scope", "slice", "seed", F.col("n").alias("n_rows"), ratio("p", "n").alias("up_rate"), C.base_f1().alias("dummy_macro_f1"),
                    C.macro_f1().alias("candidate_macro_f1"), C.delta_f1().alias("delta_vs_dummy"))
    return with_seed_mean(rows, ["scope", "slice"], ["up_rate", "dummy_macro_f1", "candidate_macro_f1", "delta_vs_dummy"],
                          F.round(F.avg("n_rows")).cast("long"))


def row_pooled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pool rows per seed, then average the seeds' deltas."""
    g = cells.groupBy(*keys, "seed").agg(*C.resum()).select(*keys, C.delta_f1().alias("_d"))
    return (g.groupBy(*keys) if keys else g.groupBy()).agg(F.avg("_d").alias("row_pooled_delta"))


def equal_weight(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over (period, seed) cells, and how many periods are positive on average."""
    u = cells.groupBy(*keys, "period_id", "seed").agg(*C.resum()).select(*keys, "period_id", C.delta_f1().alias("_d"))
    per = u.groupBy(*keys, "period_id").agg(F.avg("_d").alias("_m"), F.sum("_d").alias("_s"), F.count("_d").alias("_c"))
    return (per.groupBy(*keys) if keys else per.groupBy()).agg(
        ratio(F.sum("_s"), F.sum("_c")).alias("equal_weight_delta"),
        F.count_if(F.col("_m") > 0).alias("positive_period_count"), F.count("*").alias("n_periods"))


def loo_summary(rows: DataFrame) -> DataFrame:
    """Summary row per estimand: sign survival, worst and most influential drop."""
    b, a = F.col("baseline_delta"), F.col("delta_after_drop")
    flip = F.when(F.max(b) > 0, F.bool_or(a <= 0)).when(F.max(b) < 0, F.bool_or(a >= 0)).otherwise(F.lit(True))
    return rows.groupBy("estimand").agg(
        F.count("*").alias("n_units"), F.max("baseline_delta").alias("baseline_delta"), (~flip).alias("sign_survives"),
        F.min_by("left_out", F.struct("delta_after_drop", "left_out")).alias("worst_drop"), F.min("delta_after_drop").alias("worst_after"),
        F.max_by("left_out", F.struct(F.abs(a - b), F.col("left_out"))).alias("most_influential"))


def equal_weight_loo(units: DataFrame, estimand: str, unit: str, value: str) -> DataFrame:
    """Drop each unit and re-average: (sum - x) / (n - 1); units are configured slices."""
    every = Window.partitionBy()
    s, n = F.sum(value).over(every), F.count(value).over(every)
    x = units.select(F.lit(estimand).alias("estimand"), F.col(unit).alias("left_out"), (n - 1).alias("n_units_remaining"),
                     ratio(s - F.col(value), n - 1).alias("delta_after_drop"), ratio(s, n).alias("baseline_delta"))
    return x.withColumns({"delta_shift": F.col("delta_after_drop") - F.col("baseline_delta"),
                          "sign_after_drop": F.col("delta_after_drop") > 0})


def row_pooled_loo(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Row-pooled delta without each slice: totals minus slice counts, then F1, then seeds."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("left_out")) for a in axes])
    s = (cells.withColumn("_x", F.explode(pairs)).groupBy("seed", "_x").agg(*C.resum())
         .select("seed", "_x.axis", "_x.left_out", *C.SUMS))
    w = Window.partitionBy("seed", "axis")
    d = s.select("seed", "axis", "left_out", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in C.SUMS],
                 *[F.sum(c).over(w).alias("_" + c) for c in C.SUMS])
    full = C.macro_f1("_n", "_p", "_pp", "_tp") - C.base_f1("_n", "_p", "_bp", "_btp")
    g = d.groupBy("axis", "left_out").agg(F.sum("n").alias("n_units_remaining"), F.avg(C.delta_f1()).alias("delta_after_drop"),
                                          F.avg(full).alias("baseline_delta"))
    return g.select(F.concat(F.lit("row_pooled_over_"), "axis").alias("estimand"), "left_out", "n_units_remaining", "delta_after_drop",
                    "baseline_delta", (F.col("delta_after_drop") - F.col("baseline_delta")).alias("delta_shift"),
                    (F.col("delta_after_drop") > 0).alias("sign_after_drop"))


def multiplicity(cells: DataFrame, pooled: bool) -> tuple[DataFrame, DataFrame]:
    """(family rows, summary row) over the family x period matrix of seed-mean deltas.

    Each cell is the seed mean of a period's pooled delta. ``pooled`` centres a family on its
    delta over all rows, else on the equal-weight mean of its periods.
    """
    from ..functions.student_t import lcb_agg
    from .resample import cscv_pbo, family_cis

    u = cells.groupBy("model_family", "period_id", "seed").agg(*C.resum()).select("model_family", "period_id", C.delta_f1().alias("_d"))
    m = u.groupBy("model_family", "period_id").agg(F.avg("_d").alias("delta"))
    fam = m.groupBy("model_family").agg(
        F.count("*").alias("n_periods"), F.count_if(F.col("delta") > 0).alias("positive_periods"), F.avg("delta").alias("mean_delta"),
        lcb_agg(F.col("delta")).alias("period_delta_lcb"))
    if pooled:
        fam = fam.drop("mean_delta").join(row_pooled(cells, ["model_family"]).withColumnRenamed("row_pooled_delta", "mean_delta"), "model_family")
    agg = family_cis(fam.select(F.col("period_delta_lcb").alias("lcb"), F.col("mean_delta").alias("mean")), [])
    pbo = cscv_pbo(m, trial="model_family", block="period_id", perf="delta")
    return fam, agg.crossJoin(pbo)  # one row each


def roster_gaps(cells: DataFrame) -> DataFrame:
    """(family, period) cells of the full grid that have no rows; the grid is the configured roster."""
    have = cells.select("model_family", "period_id").distinct()
    grid = have.select("model_family").distinct().crossJoin(F.broadcast(have.select("period_id").distinct()))
    return grid.join(have, ["model_family", "period_id"], "left_anti")


def guarded_label_shuffle(cells: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """Shuffled macro-F1 per tercile against the observed; the worst shuffle over draws and seeds."""
    from ..session import materialise
    from .resample import shuffled_counts

    blocks = materialise(with_terciles(cells.groupBy("seed", "ticker", "trading_day").agg(*C.resum())), "tercile-blocks")
    scope = F.explode(F.array(F.lit("all"), F.col("activity_tercile")))
    sums = shuffled_counts(blocks, ["activity_tercile", "seed"], n_perm, seed).groupBy("activity_tercile", "seed", "draw").agg(
        *[F.sum(c).alias(c) for c in ("n", "p", "pp", "tp")])
    null = sums.withColumn("activity_tercile", scope).groupBy("activity_tercile", "seed", "draw").agg(
        *[F.sum(c).alias(c) for c in ("n", "p", "pp", "tp")])
    s = null.groupBy("activity_tercile").agg(F.avg(C.macro_f1()).alias("shuffled_macro_f1_mean"), F.max(C.macro_f1()).alias("shuffled_macro_f1_max"))
    o = blocks.withColumn("activity_tercile", scope).groupBy("activity_tercile", "seed").agg(*C.resum()).groupBy("activity_tercile").agg(
        F.round(F.avg("n")).cast("long").alias("n_rows"), F.avg(C.macro_f1()).alias("observed_macro_f1"), F.avg(C.base_f1()).alias("dummy_macro_f1"))
    j = o.join(s, "activity_tercile")
    d = F.col("dummy_macro_f1")
    return j.withColumns({
        "observed_delta_vs_dummy": F.col("observed_macro_f1") - d, "shuffled_delta_mean": F.col("shuffled_macro_f1_mean") - d,
        "shuffled_delta_max": F.col("shuffled_macro_f1_max") - d, "n_perms": F.lit(n_perm),
        "observed_exceeds_shuffle_max": F.col("observed_macro_f1") > F.col("shuffled_macro_f1_max")})


def estimand_contrast(cells: DataFrame) -> DataFrame:
    """Row-pooled and equal-weight deltas of the two domains: four one-row results."""
    t = guarded_terciles(cells).filter("seed = 'seed_mean'")
    parts = [("guarded_walkforward", "row_pooled", "row", row_pooled(cells, []).select(F.col("row_pooled_delta").alias("pooled_delta"))),
             ("guarded_walkforward", "equal_weight", "walkforward_period", equal_weight(cells, []).select(F.col("equal_weight_delta").alias("pooled_delta"))),
             ("official_validation", "row_pooled", "row", t.filter("activity_tercile = 'all'").select(F.col("delta_vs_dummy").alias("pooled_delta"))),
             ("official_validation", "equal_weight", "activity_tercile", t.filter("activity_tercile <> 'all'").agg(F.avg("delta_vs_dummy").alias("pooled_delta")))]
    out = None
    for domain, how, unit, df in parts:
        row = df.select(F.lit(domain).alias("evidence_domain"), F.lit(how).alias("aggregation"), F.lit(unit).alias("weight_unit"), "pooled_delta")
        out = row if out is None else out.unionByName(row)
    return out
