"""Baselines that learn nothing but the train prior, scored on the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import confusion as C
from ..functions.scalar import hash01, ratio

# Fixed registry ids.
REGISTRY = ("stratified_dummy_train_prior", "majority_train_prior", "constant_up", "constant_down")


def train_prior(train: DataFrame, keys: list[str], label: str = "y_true") -> DataFrame:
    return train.groupBy(*keys).agg(ratio(F.sum(label), F.count("*")).alias("prior"))


def stratified_dummy(prior: Column, seed: Column, sample_id: Column) -> Column:
    """A draw from the prior keyed by seed and sample: same under any partitioning."""
    return F.when(hash01("dummy", seed, sample_id) < prior, 1).otherwise(0)


def majority(prior: Column) -> Column:
    """Most frequent train class; a tie goes to the smaller class."""
    return F.when(prior > 0.5, 1).otherwise(0)


def registry_predictions(scored: DataFrame) -> DataFrame:
    """Long form: one row per sample and baseline id, from the row's own prior."""
    options = F.array(
        F.struct(F.lit(REGISTRY[0]).alias("baseline_id"), F.col("base_pred").alias("baseline_pred")),
        F.struct(F.lit(REGISTRY[1]).alias("baseline_id"), majority(F.col("prior")).alias("baseline_pred")),
        F.struct(F.lit(REGISTRY[2]).alias("baseline_id"), F.lit(1).alias("baseline_pred")),
        F.struct(F.lit(REGISTRY[3]).alias("baseline_id"), F.lit(0).alias("baseline_pred")))
    return scored.withColumn("_b", F.explode(options)).select("*", "_b.*").drop("_b")


def score_registry(scored: DataFrame, keys: list[str]) -> DataFrame:
    """All four baselines from one aggregate: constants need supports only.

    The majority and the constants are functions of (n, p, prior), so rows are never exploded.
    """
    g = scored.groupBy(*keys, "prior").agg(*C.row_sums())
    zero = F.col("n") * 0
    pick = F.when(F.col("prior") > 0.5, 1).otherwise(0)
    options = F.array(
        F.struct(F.lit(REGISTRY[0]).alias("baseline_id"), F.col("bp").alias("x"), F.col("btp").alias("t")),
        F.struct(F.lit(REGISTRY[1]).alias("baseline_id"), (pick * F.col("n")).alias("x"), (pick * F.col("p")).alias("t")),
        F.struct(F.lit(REGISTRY[2]).alias("baseline_id"), F.col("n").alias("x"), F.col("p").alias("t")),
        F.struct(F.lit(REGISTRY[3]).alias("baseline_id"), zero.alias("x"), zero.alias("t")))
    long = g.withColumn("_b", F.explode(options)).select(*keys, "prior", "n", "p", "_b.*")
    return long.groupBy(*keys, "baseline_id").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("x").alias("pp"), F.sum("t").alias("tp")).select(
        *keys, "baseline_id", "n", C.macro_f1().alias("macro_f1"), C.balanced_accuracy().alias("balanced_accuracy"),
        C.accuracy().alias("accuracy"), C.mcc().alias("mcc"))


def replay_gate(replayed: DataFrame, recorded: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row per seed: how many recorded figures the replay reproduces, and all-or-nothing."""
    j = replayed.select("seed", "figure", F.col("value").alias("_a")).join(
        recorded.select("seed", "figure", F.col("value").alias("_b")), ["seed", "figure"], "full_outer")
    hit = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    per = j.groupBy("seed").agg(F.count("*").alias("n_figures"), F.count_if(hit).alias("n_equal"))
    every = per.agg(F.min(F.col("n_figures") == F.col("n_equal")).alias("_all"))
    return per.crossJoin(F.broadcast(every)).select(  # one row
        "seed", "n_figures", "n_equal",
        F.when(F.col("_all"), "verified_identical").otherwise("mismatch_deltas_not_computed").alias("recon_status"))


def replay_figures(cells: DataFrame) -> DataFrame:
    """The gated figures of the dummy in long form, from block or row sums."""
    s = cells.groupBy("seed").agg(*C.resum())
    b = ("n", "p", "bp", "btp")
    wide = s.select("seed", F.explode(F.create_map(
        F.lit("macro_f1"), C.macro_f1(*b), F.lit("accuracy"), C.accuracy(*b),
        F.lit("mcc"), C.mcc(*b))).alias("figure", "value"))
    t = cells.groupBy("seed", "ticker").agg(*C.resum()).select(
        "seed", F.concat(F.lit("delta:"), "ticker").alias("figure"), C.delta_f1().alias("value"))
    return wide.unionByName(t)
