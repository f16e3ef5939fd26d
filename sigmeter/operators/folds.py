"""Chronological folds, fold membership and the even-stride cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .ranks import group_rank, join_on_groups

POLICY = "chronological_expanding_day_block_no_overlap"


def train_inner_folds(events: DataFrame, n_folds: int) -> DataFrame:
    """Expanding day-block folds from a per-day summary (one row per calendar day)."""
    days = events.groupBy("trading_day").agg(
        F.count("*").alias("n"), F.min("target_timestamp").alias("lo"), F.max("target_timestamp").alias("hi"))
    order = Window.orderBy("trading_day")
    every = Window.partitionBy()
    d = (days.withColumn("i", F.row_number().over(order) - 1).withColumn("nd", F.count("*").over(every))
         .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))))
    span = F.greatest(F.lit(1), F.floor(F.col("nd") / (n_folds + 1)).cast("int"))
    cut = F.least(F.col("nd") - 1, span * (F.col("fold") + 1))
    stop = F.when(F.col("fold") == n_folds - 1, F.col("nd")).otherwise(
        F.least(F.col("nd"), span * (F.col("fold") + 2)))
    is_train = F.col("i") < cut
    is_eval = (F.col("i") >= cut) & (F.col("i") < stop)
    d = d.withColumns({"tr": is_train, "ev": is_eval})
    d = d.withColumn("eval_start", F.min(F.when(F.col("ev"), F.col("lo"))).over(Window.partitionBy("fold")))
    g = d.groupBy("fold").agg(
        F.min(F.when(F.col("tr"), F.col("lo"))).alias("train_start"),
        F.first("eval_start").alias("eval_start"),
        F.max(F.when(F.col("ev"), F.col("hi"))).alias("hi"),
        F.coalesce(F.sum(F.when(F.col("tr"), F.col("n"))), F.lit(0)).alias("n_train_samples"),
        F.coalesce(F.sum(F.when(F.col("ev"), F.col("n"))), F.lit(0)).alias("n_eval_samples"),
        F.coalesce(F.sum(F.when(F.col("tr") & (F.col("hi") >= F.col("eval_start")), F.col("n"))),
                   F.lit(0)).alias("event_overlap_count"))
    return g.select(
        F.concat(F.lit("fold_"), "fold").alias("fold_id"), "train_start",
        F.col("eval_start").alias("train_end_exclusive"), "eval_start",
        (F.col("hi") + F.expr("INTERVAL '1' MICROSECOND")).alias("eval_end_exclusive"),
        F.lit(POLICY).alias("purge_or_embargo_policy"), "n_train_samples", "n_eval_samples",
        "event_overlap_count")


def fold_rows(events: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows tagged train or eval per fold, by timestamp range; the fold side is a handful of rows."""
    t = F.col("target_timestamp")
    train = (t >= F.col("train_start")) & (t < F.col("train_end_exclusive"))
    evals = (t >= F.col("eval_start")) & (t < F.col("eval_end_exclusive"))
    return (events.join(F.broadcast(folds.select("fold_id", "train_start", "train_end_exclusive",
                                                 "eval_start", "eval_end_exclusive")), train | evals)
            .withColumn("fold_side", F.when(train, "train").otherwise("eval"))
            .drop("train_start", "train_end_exclusive", "eval_start", "eval_end_exclusive"))


def walkforward_rows(rows: DataFrame, periods: DataFrame, ts: str = "target_timestamp") -> DataFrame:
    """Expanding train (before the period) and bounded test (inside it), per period."""
    t = F.col(ts)
    cond = t < F.col("period_end")
    return rows.join(F.broadcast(periods), cond).withColumn(
        "fold_side", F.when(t < F.col("period_start"), "train").otherwise("test")).drop(
        "period_start", "period_end")


def expanding_sums(rows: DataFrame, periods: DataFrame, sums: dict[str, Column], ts: str = "target_timestamp") -> DataFrame:
    """Sums over every period's expanding train side and bounded test side: (period_id, fold_side, sums).

    Periods follow each other without gaps. A row is counted once, in the segment between two period starts that it
    falls into; running sums over the few segments give every train side, so history is never repeated per period.
    """
    starts = periods.agg(F.array_sort(F.collect_list(F.struct("period_start", "period_end", "period_id"))).alias("_p"))  # one row of configured periods
    t = F.col(ts)
    at = F.size(F.filter("_p", lambda p: p["period_start"] <= t))  # 0: before the first period
    tagged = rows.crossJoin(F.broadcast(starts)).withColumn("_s", at).filter((F.col("_s") == 0) | (t < F.element_at("_p", F.greatest(F.col("_s"), F.lit(1)))["period_end"]))
    per = tagged.groupBy("_s").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    grid = starts.select(F.posexplode("_p").alias("_i", "_q")).select((F.col("_i") + 1).alias("_s"), "_q.period_id")
    every = grid.unionByName(grid.select(F.lit(0).alias("_s"), F.lit(None).cast("string").alias("period_id")).limit(1)).join(per, "_s", "left")
    past = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    run = every.select("period_id", *[F.struct(F.sum(k).over(past).alias("train"), F.col(k).alias("test")).alias(k) for k in sums]).filter("period_id IS NOT NULL")
    sides = F.array(*[F.struct(F.lit(side).alias("fold_side"), *[F.col(f"{k}.{side}").alias(k) for k in sums]) for side in ("train", "test")])
    return run.select("period_id", F.explode(sides).alias("_x")).select("period_id", "_x.*").filter(F.col(next(iter(sums))).isNotNull())


def stride_hit(pos: Column, n: Column, per: Column) -> Column:
    """Whether 0-based ``pos`` of ``n`` is one of ``per`` even-stride positions (all if they fit)."""
    step = (n - 1).cast("double") / F.greatest(per - 1, F.lit(1)).cast("double")
    guess = F.ceil(pos / F.when(step > 0, step).otherwise(1.0))
    hit = (pos == n - 1) | (pos == 0)
    for g in (guess, guess - 1):  # the division may land one off either way
        hit = hit | ((g >= 0) & (g < per - 1) & (F.floor(g * step) == pos))
    return (n <= per) | F.when(per == 1, pos == 0).otherwise(hit)


def even_stride_cap(rows: DataFrame, cap: int, groups: list[str] | None = None,
                    order: tuple[str, ...] = ("target_timestamp", "sample_id")) -> DataFrame:
    """Even-stride sample per group, at most ``cap`` rows in all; whole input when it fits.

    A row is kept when its position is floor(i * step) for some i, which its own position and
    its group's size decide: no list of positions is joined.
    """
    groups = groups or ["ticker", "label"]
    rk = group_rank(rows, groups, [F.col(c).asc() for c in order])
    sizes = rk.groupBy(*groups).agg(F.max("group_n").alias("_n"))
    every = Window.partitionBy()
    sizes = sizes.select(*groups, F.sum("_n").over(every).alias("_total"),
                         F.count("*").over(every).alias("_groups"),
                         F.row_number().over(Window.orderBy(*groups)).alias("_order"))
    per = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("_groups")).cast("long"))
    hit = stride_hit(F.col("rk") - 1, F.col("group_n"), per)
    keep = (F.col("_total") <= cap) | (hit & ((F.col("_groups") <= cap) | (F.col("_order") <= cap)))
    return (join_on_groups(rk, materialise(sizes, "group-sizes"), groups)
            .filter(keep)
            .drop("_total", "_groups", "_order", "group_n", "rk"))


def capped_fold_rows(members: DataFrame, cap: int, eval_cap: int | None = None) -> DataFrame:
    """Caps inside every (fold, side): ``cap`` on rows to fit on, ``eval_cap`` (none by default) on rows to evaluate.

    Group sizes come from one small aggregate.
    """
    keys, groups = ["fold_id", "fold_side"], ["fold_id", "fold_side", "ticker", "label"]
    rk = group_rank(members, groups, [F.col("target_timestamp").asc(), F.col("sample_id").asc()])
    per_side = Window.partitionBy(*keys)
    sizes = rk.groupBy(*groups).agg(F.max("group_n").alias("_n")).select(
        *groups, F.sum("_n").over(per_side).alias("_total"), F.count("*").over(per_side).alias("_groups"),
        F.row_number().over(per_side.orderBy("ticker", "label")).alias("_order"))
    most = F.when(F.col("fold_side") == "train", F.lit(cap)).otherwise(F.lit(eval_cap).cast("int"))
    per = F.greatest(F.lit(1), F.floor(most / F.col("_groups")).cast("long"))
    keep = most.isNull() | (F.col("_total") <= most) | (stride_hit(F.col("rk") - 1, F.col("group_n"), per)
                                                        & ((F.col("_groups") <= most) | (F.col("_order") <= most)))
    return join_on_groups(rk, materialise(sizes, "group-sizes"), groups).filter(keep).drop("_n", "_total", "_groups", "_order", "group_n", "rk")


def early_stop_tail(train: DataFrame, group: list[str], fraction: float, min_eval: int,
                    min_train: int) -> DataFrame:
    """Tags the chronological tail of each group; ``reason`` says why a group has none."""
    order = [F.col(c).asc() for c in ("target_timestamp", "trading_day", "ticker", "sample_id")]
    rk = group_rank(train, group, order)
    n = F.col("group_n")
    n_eval = F.greatest(F.lit(min_eval), F.ceil(n * F.lit(fraction)).cast("int"))
    rk = rk.withColumn("_tail", F.col("rk") > n - n_eval)
    ones = F.when(F.col("label") == 1, 1).otherwise(0)
    mix = rk.groupBy(*group).agg(
        F.max("group_n").alias("_n"),
        *[F.sum(F.when(F.col("_tail") == side, ones)).alias(f"_up_{side}") for side in (True, False)],
        *[F.count_if(F.col("_tail") == side).alias(f"_n_{side}") for side in (True, False)])
    short = (F.col("_n_True") >= F.col("_n")) | (F.col("_n_False") < min_train)
    single = F.lit(False)
    for side in ("True", "False"):
        single = single | (F.col(f"_up_{side}") == 0) | (F.col(f"_up_{side}") == F.col(f"_n_{side}"))
    reason = (F.when(short, "insufficient_inner_train_rows_for_minimum_validation_subsplit")
              .when(single, "inner_train_early_stopping_subsplit_single_class")
              .otherwise("configured_inner_train_subsplit"))
    mix = mix.select(*group, reason.alias("reason"))
    return rk.join(mix, group).withColumn(
        "is_stop", F.col("_tail") & (F.col("reason") == "configured_inner_train_subsplit")).drop("_tail", "rk", "group_n")
