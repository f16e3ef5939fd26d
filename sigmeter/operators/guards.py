"""Row filters and fail-closed checks, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ContractError, require


def valid_events(events: DataFrame, split: str) -> DataFrame:
    """Valid rows of one split, typed. ``require_rows`` makes an empty result fail."""
    return events.filter((F.col("split") == split) & F.col("valid_label")).select(
        "sample_id", "ticker", F.col("target_timestamp").cast("timestamp_ntz").alias("target_timestamp"),
        "trading_day", "split", F.col("label").cast("int").alias("label"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{what}: no rows")
    return df


def domain_bounds(df: DataFrame, ts_cols: list[str], start: str, end: str) -> DataFrame:
    """One row: bounds of every timestamp column, the splits seen, and whether all is inside."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    aggs = [f(c).alias(f"{n}_{c}") for c in ts_cols for n, f in (("min", F.min), ("max", F.max))]
    out = df.agg(*aggs, F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"))
    inside = F.lit(True)
    for c in ts_cols:
        inside = inside & (F.col(f"min_{c}") >= lo) & (F.col(f"max_{c}") < hi)
    return out.withColumn("inside", inside & (F.col("splits") == "train"))


def assert_train_only(df: DataFrame, ts_cols: list[str], start: str, end: str) -> DataFrame:
    if not domain_bounds(df, ts_cols, start, end).first()["inside"]:
        raise ContractError("rows outside the train domain")
    return df


def dump_checks(dump: DataFrame, seeds: tuple[int, ...], holdout: str,
                expected_rows: int | None = None) -> DataFrame:
    """One row of gate results for a prediction dump."""
    seed_text = ",".join(str(s) for s in sorted(seeds))
    return dump.agg(
        F.count("*").alias("n_rows"),
        (F.lit(True) if expected_rows is None else F.count("*") == expected_rows).alias("rows_ok"),
        (F.count_if(F.col("candidate_role") != "primary") == 0).alias("role_ok"),
        (F.count_if(F.col("scope") != "validation_only") == 0).alias("scope_ok"),
        (F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), ",")
         == seed_text).alias("seeds_ok"),
        (F.max("target_timestamp") < F.lit(holdout).cast("timestamp_ntz")).alias("holdout_ok"))


def gate_dump(dump: DataFrame, seeds: tuple[int, ...], holdout: str,
              expected_rows: int | None = None) -> DataFrame:
    row = dump_checks(dump, seeds, holdout, expected_rows).first().asDict()
    failed = [k for k, v in row.items() if k.endswith("_ok") and not v]
    if failed:
        raise ContractError(f"prediction dump: failed {failed}")
    return dump


def confidence(p_up: Column) -> Column:
    return F.greatest(p_up, 1.0 - p_up)


def derive_dump(dump: DataFrame) -> DataFrame:
    from .bars import calendar_columns

    return calendar_columns(dump).withColumns({
        "correct": (F.col("y_true") == F.col("y_pred")).cast("int"),
        "confidence": confidence(F.col("p_up"))})


def require_single_domain(df: DataFrame, column: str, what: str) -> DataFrame:
    return require(df, {"single_domain": F.count_distinct(column) <= 1}, what)


def embargo(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Evaluation rows without their fold's first evaluation day; folds are a handful."""
    first = folds.select("fold_id", F.date_format("eval_start", "yyyy-MM-dd").alias("_first"))
    return rows.join(F.broadcast(first), "fold_id").filter(F.col("trading_day") != F.col("_first")).drop("_first")


def pending_units(plan: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    done = ledger.filter(F.col("fit_status") == "completed").select(*keys)
    return plan.join(done, keys, "left_anti")
