"""Spread proxies per (ticker, trading_day) and readouts partitioned by them.

Bars reduce to one row of sufficient sums per day first; trailing windows then run over days
(bounded by the calendar), never over bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import confusion as C
from ..functions.scalar import ratio, safe_log

# Fixed cell names and edges.
LE_HALF, HALF_TO_1, ONE_TO_2, GT_2 = "ratio_le_0p5", "ratio_0p5_to_1", "ratio_1_to_2", "ratio_gt_2"
UNDEFINED, INSUFFICIENT = "roll_undefined_nonneg_autocov", "insufficient_history"
FINE = (LE_HALF, HALF_TO_1, ONE_TO_2, GT_2)
LE_1, GT_1 = "ratio_le_1", "ratio_gt_1"
ALL_CELLS = ("all",) + FINE + (UNDEFINED, INSUFFICIENT, LE_1, GT_1)
EDGES = (0.5, 1.0, 2.0)

DAY_KEYS = ["ticker", "trading_day"]


def log_returns(bars: DataFrame) -> DataFrame:
    """Day-local log close returns; null, and so in no pair, beside a non-positive price."""
    w = Window.partitionBy(*DAY_KEYS).orderBy("timestamp")
    return bars.withColumn("log_return", safe_log(ratio("close", F.lag("close").over(w))))


def day_pair_stats(bars: DataFrame) -> DataFrame:
    """n, sum a, b, ab, aa, bb of consecutive same-day returns, one row per day."""
    w = Window.partitionBy(*DAY_KEYS).orderBy("timestamp")
    p = log_returns(bars).withColumn("b", F.lag("log_return").over(w)).withColumnRenamed("log_return", "a")
    a, b = F.col("a"), F.col("b")
    return p.filter(a.isNotNull() & b.isNotNull()).groupBy(*DAY_KEYS).agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * b).alias("sab"),
        F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"))


def trailing_days(stats: DataFrame, cols: list[str], days: int) -> DataFrame:
    """Sums over the previous ``days`` observed days of the ticker, the own day excluded."""
    w = Window.partitionBy("ticker").orderBy("trading_day").rowsBetween(-days, -1)
    return stats.select(*DAY_KEYS, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in cols])


def roll_halfspread(bars: DataFrame, window_days: int = 21, min_pairs: int = 400) -> DataFrame:
    t = trailing_days(day_pair_stats(bars), ["n", "sa", "sb", "sab"], window_days)
    cov = ratio(F.col("sab") - ratio(F.col("sa") * F.col("sb"), F.col("n")), F.col("n") - 1)
    enough = F.col("n") >= min_pairs
    t = t.withColumn("autocov_lag1", F.when(enough, cov))
    ok = enough & (F.col("autocov_lag1") < 0)
    status = F.when(~enough, INSUFFICIENT).when(ok, "ok").otherwise(UNDEFINED)
    return t.select(*DAY_KEYS, F.col("n").alias("n_pairs"), "autocov_lag1",
                    F.when(ok, F.sqrt(-F.col("autocov_lag1"))).alias("halfspread"), status.alias("status"))


def corwin_schultz(bars: DataFrame, window_days: int = 21, min_spans: int = 200) -> DataFrame:
    w = Window.partitionBy(*DAY_KEYS).orderBy("timestamp")
    hl = F.pow(safe_log(ratio("high", "low")), 2)
    x = bars.withColumns({"_hl": hl, "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    has = F.col("_ph").isNotNull()  # greatest/least skip nulls: the first bar has no span
    x = x.withColumn("_phl", F.lag("_hl").over(w)).select(
        *DAY_KEYS, (F.col("_hl") + F.col("_phl")).alias("beta"),
        F.when(has, F.pow(safe_log(ratio(F.greatest("high", "_ph"), F.least("low", "_pl"))), 2)).alias("gamma"))
    s = x.filter(F.col("beta").isNotNull() & F.col("gamma").isNotNull()).groupBy(*DAY_KEYS).agg(
        F.count("*").alias("n"), F.sum("beta").alias("beta"), F.sum("gamma").alias("gamma"))
    t = trailing_days(s, ["n", "beta", "gamma"], window_days)
    k = 3.0 - 2.0 * 2.0 ** 0.5
    enough = F.col("n") >= min_spans
    beta, gamma = ratio("beta", "n"), ratio("gamma", "n")
    t = t.withColumn("cs_alpha", F.when(enough, (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)))
    a = F.col("cs_alpha")
    spread = 2 * (F.exp(a) - 1) / (1 + F.exp(a))
    return t.select(*DAY_KEYS, F.col("n").alias("cs_n_spans"), "cs_alpha",
                    F.when(a.isNotNull(), F.greatest(spread, F.lit(0.0)) / 2).alias("cs_halfspread"),
                    F.when(enough, "ok").otherwise(INSUFFICIENT).alias("cs_status"))


def spread_partition(days: DataFrame, band: float, edges: tuple[float, float, float] = EDGES) -> DataFrame:
    """Half-spread over the band and its right-closed cell; undefined days keep their own cells."""
    if band <= 0 or not 0 < edges[0] < edges[1] < edges[2]:
        raise ValueError("band must be positive and edges increasing")
    r = F.col("spread_band_ratio")
    cell = (F.when(F.col("status") == UNDEFINED, UNDEFINED).when(F.col("status") != "ok", INSUFFICIENT)
            .when(r <= edges[0], LE_HALF).when(r <= edges[1], HALF_TO_1).when(r <= edges[2], ONE_TO_2).otherwise(GT_2))
    return days.withColumn("spread_band_ratio", F.col("halfspread") / F.lit(float(band))).withColumn("cell", cell)


def merge_spreads(roll: DataFrame, cs: DataFrame) -> DataFrame:
    return roll.join(cs, DAY_KEYS, "left").withColumn("cs_status", F.coalesce("cs_status", F.lit(INSUFFICIENT)))


def cell_memberships(cell: Column) -> Column:
    """Every reported cell a day belongs to: all, its own, and its coarse anchor."""
    coarse = F.when(cell.isin(LE_HALF, HALF_TO_1), LE_1).when(cell.isin(ONE_TO_2, GT_2), GT_1)
    return F.array_compact(F.array(F.lit("all"), cell, coarse))


def partition_readout(cells: DataFrame, day_cells: DataFrame, n_boot: int | None, seed: int,
                      report_min_rows: int = 200, random_prior: float = 0.5) -> DataFrame:
    """Every cell x seed and the seed mean; empty cells stay. ``cells`` are block counts per seed."""
    from .resample import block_bootstrap

    b = cells.groupBy("seed", *DAY_KEYS).agg(*C.resum()).join(day_cells.select(*DAY_KEYS, "cell"), DAY_KEYS, "left")
    b = b.withColumn("cell", F.coalesce("cell", F.lit(INSUFFICIENT)))
    long = b.withColumn("cell", F.explode(cell_memberships(F.col("cell"))))
    g = long.groupBy("cell", "seed").agg(*C.resum(), F.count("*").alias("n_days"))
    grid = cells.select("seed").distinct().withColumn("cell", F.explode(F.array(*[F.lit(c) for c in ALL_CELLS])))
    rows = grid.join(g, ["cell", "seed"], "left")
    n = F.coalesce("n", F.lit(0))
    out = rows.select("cell", "seed", n.alias("n_rows"), F.coalesce("n_days", F.lit(0)).alias("n_days"), ratio("p", "n").alias("up_rate"),
                      C.macro_f1().alias("macro_f1"), C.base_f1().alias("dummy_macro_f1"), C.delta_f1().alias("delta_vs_dummy"))
    lo = hi = F.lit(None).cast("double")
    if n_boot:
        ci = block_bootstrap(long, ["cell", "seed"], n_boot, seed)
        out = out.join(ci.select("cell", "seed", "lcb", "ucb"), ["cell", "seed"], "left")
        lo, hi = F.col("lcb"), F.col("ucb")
    stats = ["up_rate", "macro_f1", "dummy_macro_f1", "delta_vs_dummy"]
    per = out.select("cell", F.col("seed").cast("string").alias("seed"), "n_rows", "n_days", *stats, lo.alias("boot_delta_lcb"),
                     hi.alias("boot_delta_ucb"), (F.col("n_rows") < report_min_rows).alias("thin_cell"),
                     F.when(F.col("n_rows") == 0, "empty_cell").otherwise("").alias("note"))
    mean = per.groupBy("cell").agg(F.sum("n_rows").alias("n_rows"), F.max("n_days").alias("n_days"), *[F.avg(c).alias(c) for c in stats],
                                   F.bool_or("thin_cell").alias("thin_cell")).withColumns({
        "seed": F.lit("seed_mean"), "note": F.lit(""), "boot_delta_lcb": F.lit(None).cast("double"), "boot_delta_ucb": F.lit(None).cast("double")})
    return per.unionByName(mean).withColumn("below_random_prior", F.coalesce(F.col("macro_f1") < random_prior, F.lit(False)))


def occupancy(cells: DataFrame, day_cells: DataFrame, terciles: DataFrame) -> DataFrame:
    """Rows and distinct days per cell x tercile; a block is one (ticker, day)."""
    b = cells.groupBy(*DAY_KEYS).agg(F.sum("n").alias("n")).join(day_cells.select(*DAY_KEYS, "cell"), DAY_KEYS, "left").join(terciles, DAY_KEYS)
    return b.groupBy(F.coalesce("cell", F.lit(INSUFFICIENT)).alias("cell"), "activity_tercile").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_days"))


def autocov_by_tercile(bars: DataFrame, terciles: DataFrame) -> DataFrame:
    s = day_pair_stats(bars).join(terciles, DAY_KEYS).withColumn(
        "activity_tercile", F.explode(F.array(F.lit("all"), F.col("activity_tercile"))))
    g = s.groupBy("activity_tercile").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])
    n = F.col("n")
    cov = F.col("sab") - ratio(F.col("sa") * F.col("sb"), n)
    va, vb = F.col("saa") - ratio(F.col("sa") * F.col("sa"), n), F.col("sbb") - ratio(F.col("sb") * F.col("sb"), n)
    return g.select("activity_tercile", n.alias("n_pairs"), F.when(n >= 2, ratio(cov, n - 1)).alias("autocov_lag1"),
                    F.when((n >= 2) & (va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(va * vb))).alias("autocorr_lag1"))
