"""Equi-joins with completeness checks. No hints: sizes at run time decide the physical join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import assert_columns


def bar_position(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Each event with the 0-based position of its bar in the day; events off the grid drop out."""
    order = Window.partitionBy("ticker", "trading_day").orderBy("timestamp")
    pos = bars.select("ticker", "trading_day", F.col("timestamp").alias("target_timestamp"),
                      (F.row_number().over(order) - 1).alias("bar_position"))
    return events.join(pos, ["ticker", "trading_day", "target_timestamp"])


def join_report(left: DataFrame, right: DataFrame, keys: list[str], probe: str) -> DataFrame:
    """One row: duplicate right keys, left rows, and left rows without a partner.

    The right side is counted per key first, so a repeated key cannot multiply the left side.
    """
    r = right.groupBy(*keys).agg(F.count("*").alias("_dups"))
    dup = r.agg(F.count_if(F.col("_dups") > 1).alias("duplicate_keys"))
    l = left.groupBy(*keys).agg(F.count("*").alias("_rows"))
    miss = l.join(r, keys, "left").agg(
        F.sum("_rows").alias("left_rows"),
        F.coalesce(F.sum(F.when(F.col("_dups").isNull(), F.col("_rows"))), F.lit(0)).alias("unmatched_rows"))
    return miss.crossJoin(dup)  # one row each


def partner_check(what: str, extra: dict[str, Column] | None = None) -> Column:
    """Null for a row that met exactly one partner, else an error that stops the job when the row is read.

    ``_n`` is the number of right rows of the key; ``extra`` names further faults.
    """
    out = F.when(F.col("_n").isNull(), F.raise_error(F.lit(f"{what}: a row without a partner"))).when(
        F.col("_n") > 1, F.raise_error(F.lit(f"{what}: a key with several partners")))
    for fault, bad in (extra or {}).items():
        out = out.when(bad, F.raise_error(F.lit(f"{what}: {fault}")))
    return out


def checked_left_join(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Left join in which every row must meet exactly one partner.

    The check rides on the join: the right side is counted per key first, so a repeated key cannot multiply
    rows, and a fault raises where a joined column of its row is computed. Building the frame runs no job.
    """
    assert_columns(left, keys, what)
    assert_columns(right, keys, what)
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    joined = left.join(once, keys, "left")
    fault = partner_check(what)
    return joined.withColumns({c: F.when(fault.isNotNull(), F.lit(None)).otherwise(F.col(c)) for c in rest}).drop("_n")


def attach_day_column(dump: DataFrame, days: DataFrame, column: str) -> DataFrame:
    return checked_left_join(dump, days.select("ticker", "trading_day", column), ["ticker", "trading_day"],
                             f"attach {column}")


def _baseline_once(base: DataFrame, on: list[str]) -> DataFrame:
    return base.groupBy(*on).agg(F.count("*").alias("_n"), F.first("y_pred").alias("base_pred"), F.first("y_true").alias("_y"))


def align_baseline(cand: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Candidate rows with ``base_pred``; a row without one match, or with another y_true, raises when it is read."""
    joined = cand.join(_baseline_once(base, on), on, "left")
    fault = partner_check("baseline alignment", {"labels differ": ~F.col("_y").eqNullSafe(F.col("y_true"))})
    return joined.withColumn("base_pred", F.when(fault.isNotNull(), F.lit(None)).otherwise(F.col("base_pred"))).drop("_y", "_n")


def align_baselines(cand: DataFrame, base: DataFrame, on: list[str], variants: list[str]) -> DataFrame:
    """Candidate rows once per variant, with ``variant`` and its ``base_pred``; ``base`` has a prediction column per variant.

    Checked as ``align_baseline``; the two sides meet once, whatever the number of variants.
    """
    once = base.groupBy(*on).agg(F.count("*").alias("_n"), F.first("y_true").alias("_y"), *[F.first(v).alias(f"_v_{v}") for v in variants])
    joined = cand.join(once, on, "left")
    fault = partner_check("baseline alignment", {"labels differ": ~F.col("_y").eqNullSafe(F.col("y_true"))})
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.when(fault.isNotNull(), F.lit(None)).otherwise(F.col(f"_v_{v}")).alias("base_pred")) for v in variants])
    return joined.withColumn("_each", F.explode(each)).select(*cand.columns, "_each.*")


def alignment_report(cand: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """One row: rows that align, and rows with no partner, several partners or another label."""
    j = cand.join(_baseline_once(base, on), on, "left")
    one = F.col("_n") == 1
    return j.agg(F.count("*").alias("candidate_rows"), F.count_if(F.col("_n").isNull()).alias("missing_rows"), F.count_if(F.col("_n") > 1).alias("repeated_rows"),
                 F.count_if(one & (F.col("_y") != F.col("y_true"))).alias("label_mismatches"), F.count_if(one & (F.col("_y") == F.col("y_true"))).alias("aligned_rows"))


def baseline_lookup(trials: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Trials with one macro-F1 column per baseline id."""
    ids = ["stratified_dummy_train_prior", "majority_train_prior"]
    wide = baselines.groupBy(*keys).pivot("baseline_id", ids).agg(F.first("macro_f1"))
    wide = wide.select(*keys, *[F.col(i).alias("macro_f1_" + i) for i in ids])
    return trials.join(wide, keys, "left")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_overlap"))


def event_parity(rebuilt: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row: row counts, one-sided ids and label disagreements between two event sets."""
    a = rebuilt.select("sample_id", F.col("label").alias("_a"), F.lit(1).alias("_ina"))
    b = frozen.select("sample_id", F.col("label").alias("_b"), F.lit(1).alias("_inb"))
    return a.join(b, "sample_id", "full_outer").agg(
        F.count("_ina").alias("rebuilt_rows"), F.count("_inb").alias("frozen_rows"),
        F.count_if(F.col("_ina").isNull() | F.col("_inb").isNull()).alias("one_sided_rows"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_mismatches"))
