"""Forward-return direction labels with explicit validity flags.

Only same-day horizons can be valid, so prices are looked up inside (ticker, trading_day).
What lies beyond the day is needed for two flags and one timestamp; it comes from a small
per-day summary (row count and the day's first k timestamps) of the days that follow. No
window ever spans a whole ticker of bars: the widest one has a row per ticker and day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bars import SplitBoundaries, split_of
from .ranks import exact_quantiles, group_rank

BPS = 10000.0


@dataclass(frozen=True)
class LabelPolicy:
    horizon_k: int = 9
    no_trade_band_bps: float = 3.0
    bar_minutes: int = 5


def forward_returns(bars: DataFrame, horizon_k: int, bar_minutes: int,
                    splits: SplitBoundaries | None = None) -> DataFrame:
    """Bars plus raw forward return, horizon end and the four structural flags."""
    k = int(horizon_k)
    day = Window.partitionBy("ticker", "trading_day")
    ordered = day.orderBy("timestamp")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = bars.withColumns({
        "_i": F.row_number().over(ordered), "_n": F.count("*").over(whole),
        "_fclose": F.lead("close", k).over(ordered), "_fts": F.lead("timestamp", k).over(ordered),
    })
    head = (bars.withColumn("_i", F.row_number().over(ordered)).filter(F.col("_i") <= k)
            .groupBy("ticker", "trading_day")
            .agg(F.sort_array(F.collect_list("timestamp")).alias("_head")))  # at most k per day
    later = Window.partitionBy("ticker").orderBy("trading_day").rowsBetween(1, k)
    nxt = head.select("ticker", "trading_day", F.slice(
        F.flatten(F.collect_list("_head").over(later)), 1, k).alias("_next"))
    b = b.join(nxt, ["ticker", "trading_day"], "left")
    same_day = F.col("_i") + k <= F.col("_n")
    beyond = F.get("_next", (F.col("_i") + k - F.col("_n") - 1).cast("int"))
    end_ts = F.when(same_day, F.col("_fts")).otherwise(beyond)
    gap = F.timestamp_diff("MICROSECOND", F.col("timestamp"), end_ts)
    b = b.withColumn("horizon_end_timestamp", end_ts).withColumn("_same", same_day)
    fwd = F.when(F.col("_same"), F.try_divide("_fclose", "close") - 1.0)
    missing = F.col("horizon_end_timestamp").isNull() | (F.col("_same") & fwd.isNull())
    own = F.col("split")
    end_split = split_of("horizon_end_timestamp", splits) if splits else own
    return b.withColumns({
        "forward_return": fwd,
        "invalid_missing_future": missing,
        "invalid_cross_trading_day": ~F.col("_same"),
        "invalid_irregular_horizon": F.col("_same") & (gap != k * bar_minutes * 60_000_000),
        "invalid_cross_split": ~missing & (own != end_split),
    }).drop("_i", "_n", "_fclose", "_fts", "_next", "_same")


def structural_ok() -> Column:
    return ~(F.col("invalid_missing_future") | F.col("invalid_cross_trading_day")
             | F.col("invalid_irregular_horizon") | F.col("invalid_cross_split")
             | F.col("forward_return").isNull())


def direction_labels(bars: DataFrame, policy: LabelPolicy,
                     splits: SplitBoundaries | None = None) -> DataFrame:
    """Label 1 above the band, 0 below it, null inside (inclusive) or when any flag is set."""
    f = forward_returns(bars, policy.horizon_k, policy.bar_minutes, splits)
    return apply_band(f, F.lit(policy.no_trade_band_bps / BPS)).withColumn(
        "horizon_k", F.lit(int(policy.horizon_k)))


def apply_band(f: DataFrame, band: Column) -> DataFrame:
    r, ok = F.col("forward_return"), structural_ok()
    label = F.when(ok & (r > band), 1).when(ok & (r < -band), 0)
    return f.withColumns({
        "invalid_no_trade_band": ok & (F.abs(r) <= band),
        "label": label,
        "valid_label": label.isNotNull(),
        "future_cumulative_return": F.when(label.isNotNull(), r),
        "sample_id": F.concat_ws("|", "ticker", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")),
    }).drop("forward_return")


EVENT_COLUMNS = ["sample_id", "ticker", "target_timestamp", "trading_day", "split", "horizon_k",
                 "horizon_end_timestamp", "label", "future_cumulative_return", "valid_label",
                 "invalid_missing_future", "invalid_cross_trading_day", "invalid_irregular_horizon",
                 "invalid_cross_split", "invalid_no_trade_band"]


def event_index(labelled: DataFrame) -> DataFrame:
    return labelled.withColumnRenamed("timestamp", "target_timestamp").select(*EVENT_COLUMNS)


def validity_summary(labelled: DataFrame) -> DataFrame:
    flags = ["invalid_missing_future", "invalid_cross_trading_day", "invalid_irregular_horizon",
             "invalid_cross_split", "invalid_no_trade_band"]
    return (labelled.filter(F.col("split").isin("train", "validation")).groupBy("ticker", "split")
            .agg(F.count("*").alias("rows"), F.count_if("valid_label").alias("valid_label_rows"),
                 F.count_if(F.col("label") == 1).alias("up_labels"),
                 F.count_if(F.col("label") == 0).alias("down_labels"),
                 *[F.count_if(c).alias(c) for c in flags]))


def cell_profiles(bars: DataFrame, cells: list[tuple[int, float]], bar_minutes: int,
                  splits: SplitBoundaries | None = None) -> DataFrame:
    """Eligibility profile of every (horizon, band) cell.

    One forward-return pass per distinct horizon; the bands of a horizon are exploded on its
    counts only. The grid is a handful of configured literals.
    """
    parts = []
    for k in sorted({k for k, _ in cells}):
        bands = sorted({b for kk, b in cells if kk == k})
        f = forward_returns(bars, k, bar_minutes, splits).withColumn(
            "no_trade_band_bps", F.explode(F.array(*[F.lit(b) for b in bands])))
        lab = apply_band(f, F.col("no_trade_band_bps") / BPS).withColumn("horizon_k", F.lit(k))
        parts.append(lab)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cell_summary(labelled_cells: DataFrame) -> DataFrame:
    flags = ["invalid_missing_future", "invalid_cross_trading_day", "invalid_irregular_horizon",
             "invalid_cross_split", "invalid_no_trade_band"]
    return labelled_cells.groupBy("horizon_k", "no_trade_band_bps").agg(
        F.count("*").alias("n_bar_rows"), F.count_if("valid_label").alias("n_eligible_label_rows"),
        F.count_if(F.col("label") == 1).alias("up_rows"), F.count_if(F.col("label") == 0).alias("down_rows"),
        F.count_distinct(F.when(F.col("valid_label"), F.col("trading_day"))).alias("n_trading_days"),
        *[F.count_if(c).alias("n_" + c) for c in flags],
        F.avg("label").alias("up_prior"))


# The band diagnostic's thresholds and quantiles.
DIAGNOSTIC_BANDS_BPS = (3.0, 10.0, 20.0, 30.0, 50.0)
DIAGNOSTIC_QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.99)


def band_diagnostic(f: DataFrame, bands: tuple[float, ...] = DIAGNOSTIC_BANDS_BPS) -> DataFrame:
    """Counts per band plus quantiles of |return|, overall and by ticker.

    The quantiles do not depend on the band, so they are taken once per scope and joined to
    the counts; the counts are one hash aggregate with the bands as columns of an array.
    """
    base = f.filter(structural_ok()).select(
        "ticker", "forward_return", F.concat_ws("|", "ticker", "timestamp").alias("sample_key"))
    r = F.col("forward_return")
    scoped = base.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("ticker"))))
    counts = (scoped.withColumn("band_bps", F.explode(F.array(*[F.lit(b) for b in bands])))
              .groupBy("scope", "band_bps").agg(
                  F.count("*").alias("n_train_base_rows"),
                  F.count_if(F.abs(r) > F.col("band_bps") / BPS).alias("valid_rows"),
                  F.count_if(r > F.col("band_bps") / BPS).alias("up_rows"),
                  F.count_if(r < -F.col("band_bps") / BPS).alias("down_rows"),
                  F.count_if(F.abs(r) <= F.col("band_bps") / BPS).alias("no_trade_rows")))
    ranked = group_rank(scoped.select("scope", (F.abs(r) * BPS).alias("_v"), F.col("sample_key").alias("_k")),
                        ["scope"], [F.col("_v").asc(), F.col("_k").asc()])
    qs = exact_quantiles(ranked, ["scope"], "_v", list(DIAGNOSTIC_QUANTILES)).groupBy("scope").pivot(
        "q", list(DIAGNOSTIC_QUANTILES)).agg(F.first("quantile"))
    out = counts.join(qs, "scope")
    for name in ("valid", "up", "down", "no_trade"):
        out = out.withColumn(f"{name}_pct", F.try_divide(f"{name}_rows", "n_train_base_rows"))
    for q in DIAGNOSTIC_QUANTILES:
        out = out.withColumnRenamed(str(q), f"abs_return_p{round(q * 100)}_bps")
    return out
