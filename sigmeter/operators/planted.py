"""Planted-signal labels: a known rule, followed with probability 0.5 + strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import uniform64
from .joins import checked_left_join

MAX_STRENGTH = 0.5


def rule_values(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events with ``planted_rule_value``: 1 when the bar's log return is positive, else 0.

    Every event must meet exactly one bar; null returns map to 0 and are flagged.
    """
    bars = features.select("ticker", F.col("timestamp").alias("target_timestamp"), "log_return")
    j = checked_left_join(events, bars, ["ticker", "target_timestamp"], "planted rule")
    up = F.coalesce(F.col("log_return") > 0, F.lit(False))
    return j.withColumns({"planted_rule_value": up.cast("int"), "rule_is_null": F.col("log_return").isNull()}).drop("log_return")


def relabel_uniform(seed: int, arm: Column, sample_id: Column) -> Column:
    return uniform64(F.concat_ws("|", F.lit(str(seed)), arm, sample_id))


def inject(events: DataFrame, arms: dict[str, float], seed: int) -> DataFrame:
    """One relabelled copy of the events per arm; only the label changes."""
    if any(not 0 <= s <= MAX_STRENGTH for s in arms.values()):
        raise ValueError(f"strength must lie in [0, {MAX_STRENGTH}]")
    options = F.array(*[F.struct(F.lit(a).alias("arm_id"), F.lit(float(s)).alias("strength")) for a, s in arms.items()])
    x = events.withColumn("_a", F.explode(options)).select("*", "_a.*").drop("_a")
    agree = relabel_uniform(seed, F.col("arm_id"), F.col("sample_id")) < F.lit(0.5) + F.col("strength")
    rule = F.col("planted_rule_value")
    return x.withColumn("real_label", F.col("label")).withColumn("label", F.when(agree, rule).otherwise(1 - rule))


def injection_stats(relabelled: DataFrame) -> DataFrame:
    agree = (F.col("label") == F.col("planted_rule_value")).cast("double")
    return relabelled.groupBy("arm_id", "strength").agg(
        F.count("*").alias("n_rows"), F.avg("planted_rule_value").alias("rule_positive_rate"),
        F.count_if("rule_is_null").alias("rule_nan_count"), F.avg(agree).alias("realized_agreement_rate"),
        F.avg("label").alias("synthetic_up_prior"), F.avg("real_label").alias("real_up_prior"))
