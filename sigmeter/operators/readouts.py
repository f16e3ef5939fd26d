"""Metric readouts: every table here is a re-sum of confusion counts."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import confusion as C
from ..functions.student_t import lcb_agg

BLOCK = ["ticker", "trading_day"]


def block_cells(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Seven integer sums per key and (ticker, trading_day): the fact table of the readouts.

    Partial aggregation runs before the shuffle, so a hot block sends one row per task.
    """
    return scored.groupBy(*keys, *BLOCK).agg(*C.row_sums())


def metrics(cells: DataFrame, keys: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    g = cells.groupBy(*keys).agg(*C.resum())
    cols = {"n_rows": F.col("n"), "macro_f1": C.macro_f1(), "balanced_accuracy": C.balanced_accuracy(),
            "accuracy": C.accuracy(), "mcc": C.mcc()}
    cols.update(extra or {})
    return g.select(*keys, *[v.alias(k) for k, v in cols.items()])


def per_class(cells: DataFrame, keys: list[str]) -> DataFrame:
    g = cells.groupBy(*keys).agg(*C.resum())
    n, p, pp, tp = (F.col(c) for c in ("n", "p", "pp", "tp"))
    tn, f1 = n - p - pp + tp, lambda a, b: F.coalesce(C.ratio(2 * a, b), F.lit(0.0))
    return g.select(
        *keys, C.precision_up().alias("precision_up"), C.recall_up().alias("recall_up"), f1(tp, p + pp).alias("f1_up"),
        p.alias("support_up"), C.precision_up(n - pp, tn).alias("precision_down"),
        C.recall_up(n - p, tn).alias("recall_down"), f1(tn, 2 * n - p - pp).alias("f1_down"),
        (n - p).alias("support_down"))


def deltas(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(*C.resum()).select(
        *keys, F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1"), C.base_f1().alias("dummy_macro_f1"),
        C.delta_f1().alias("delta_vs_dummy"))


def positive_counts(delta_rows: DataFrame, keys: list[str], out: str = "positive_ticker_count") -> DataFrame:
    return delta_rows.groupBy(*keys).agg(F.count_if(F.col("delta_vs_dummy") > 0).alias(out))


def trial_ledger(scored: DataFrame) -> DataFrame:
    """One row per candidate x family x profile x fold (period) x seed of a prediction table.

    Every unit that has predictions is complete; failed fits are rows of ``models.failures_of``.
    """
    return ledger_of_counts(scored.groupBy(*LEDGER_KEYS).agg(*C.row_sums()))


LEDGER_KEYS = ["candidate_id", "model_family", "hpo_profile_id", "period_id", "seed", "ticker", "prior"]


def ledger_of_counts(per_ticker: DataFrame) -> DataFrame:
    """``trial_ledger`` from the seven sums per ``LEDGER_KEYS``."""
    pos = per_ticker.groupBy(*LEDGER_KEYS[:5]).agg(F.count_if(C.delta_f1() > 0).alias("positive_ticker_count"), *C.resum(),
                               F.max("prior").alias("prior"))
    maj = C.constant_f1(F.when(F.col("prior") > 0.5, 1).otherwise(0))
    return pos.select(
        "candidate_id", "model_family", "hpo_profile_id", F.col("period_id").alias("fold_id"), "seed",
        F.lit("completed").alias("fit_status"), F.col("n").alias("n_rows"),
        C.macro_f1().alias("macro_f1"), C.balanced_accuracy().alias("balanced_accuracy"), C.mcc().alias("mcc"),
        C.base_f1().alias("dummy_macro_f1"), maj.alias("majority_macro_f1"),
        C.delta_f1().alias("delta_vs_dummy"), (C.macro_f1() - maj).alias("delta_vs_majority"),
        "positive_ticker_count")


def done(c: str) -> Column:
    return F.when(F.col("fit_status") == "completed", F.col(c))


def hpo_summary(ledger: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("fit_status") == "completed")
    return ledger.groupBy("candidate_id", "model_family", "hpo_profile_id").agg(
        F.count("*").alias("expected_rows"), ok.alias("completed_rows"),
        (F.count("*") - ok).alias("failed_rows"),
        F.avg(done("macro_f1")).alias("mean_macro_f1"), F.avg(done("balanced_accuracy")).alias("mean_balanced_accuracy"),
        F.avg(done("mcc")).alias("mean_mcc"),
        F.avg(done("delta_vs_dummy")).alias("mean_delta_vs_dummy"), lcb_agg(done("delta_vs_dummy")).alias("lcb_delta_vs_dummy"),
        F.avg(done("delta_vs_majority")).alias("mean_delta_vs_majority"),
        lcb_agg(done("delta_vs_majority")).alias("lcb_delta_vs_majority"),
        F.min(done("positive_ticker_count")).alias("min_positive_ticker_count"),
        F.avg(done("positive_ticker_count")).alias("mean_positive_ticker_count"))


def group_aggregates(ledger: DataFrame, keys: list[str]) -> DataFrame:
    d = done("delta_vs_dummy")
    ok = F.count_if(F.col("fit_status") == "completed")
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("expected_rows"), ok.alias("completed_rows"), (F.count("*") - ok).alias("failed_rows"),
        F.avg(d).alias("mean_delta"), lcb_agg(d).alias("lcb_delta"),
        F.count_if(d > 0).alias("positive_sign_rows"), F.count_if(d < 0).alias("negative_sign_rows"),
        F.count_if(d == 0).alias("zero_sign_rows"), F.avg(done("dummy_macro_f1")).alias("mean_dummy_macro_f1"),
        F.min(done("positive_ticker_count")).alias("min_positive_ticker_count"),
        F.avg(done("positive_ticker_count")).alias("mean_positive_ticker_count"))


def candidate_screening(ledger: DataFrame) -> DataFrame:
    """Family statistics first, then their median, min and best per candidate."""
    c = ledger.filter("fit_status = 'completed'")
    fam = c.groupBy("candidate_id", "model_family").agg(
        F.avg("delta_vs_dummy").alias("mean_delta"), lcb_agg(F.col("delta_vs_dummy")).alias("lcb_delta"),
        F.avg("positive_ticker_count").alias("_pos"))
    best = F.struct(F.coalesce("lcb_delta", F.lit(float("-inf"))), F.coalesce("mean_delta", F.lit(float("-inf"))),
                    "model_family")
    stats = fam.groupBy("candidate_id").agg(
        F.median("mean_delta").alias("median_mean_delta"), F.median("lcb_delta").alias("median_family_lcb"),
        F.min("lcb_delta").alias("min_family_lcb"), F.max_by("model_family", best).alias("best_screening_family"),
        F.max_by("lcb_delta", best).alias("best_family_lcb"),
        F.floor(F.median("_pos")).cast("long").alias("positive_ticker_count"),
        F.count_if(F.col("mean_delta") > 0).alias("positive_family_count"))

    def spread(key: str) -> DataFrame:
        m = c.groupBy("candidate_id", key).agg(F.avg("macro_f1").alias("_m"))
        return m.groupBy("candidate_id").agg(F.coalesce(F.stddev_samp("_m"), F.lit(0.0)).alias(f"{key}_std_macro_f1"))

    base = c.groupBy("candidate_id").agg(F.avg("macro_f1").alias("mean_macro_f1"), F.sum("n_rows").alias("n_samples_total"))
    return base.join(stats, "candidate_id").join(spread("seed"), "candidate_id").join(spread("fold_id"), "candidate_id")


def ablation_summary(ledger: DataFrame, reference: str) -> DataFrame:
    """Controls (families) against the reference family; the reference is one row."""
    d = done("delta_vs_dummy")
    g = ledger.groupBy("model_family").agg(
        F.count("*").alias("n_trials"), F.count_if(F.col("fit_status") == "completed").alias("n_completed"),
        F.avg(done("macro_f1")).alias("mean_macro_f1"), F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"),
        F.avg(done("delta_vs_majority")).alias("mean_delta_vs_majority"),
        F.avg(done("positive_ticker_count")).alias("positive_ticker_count_mean"))
    ref = g.filter(F.col("model_family") == reference).select(
        F.col("mean_macro_f1").alias("reference_mean_macro_f1"), F.col("mean_delta").alias("reference_mean_delta"))
    return g.filter(F.col("model_family") != reference).crossJoin(F.broadcast(ref)).withColumn(
        "gap_to_reference_mean_delta", F.col("mean_delta") - F.col("reference_mean_delta"))


def seed_dispersion(per_seed: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("n_seeds")]
    for c in ("macro_f1", "delta_vs_dummy", "positive_ticker_count"):
        aggs += [F.min(c).cast("double").alias("min_" + c), F.median(c).alias("median_" + c),
                 F.max(c).cast("double").alias("max_" + c)]
    aggs += [F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_samp("macro_f1").alias("std_macro_f1"),
             F.avg("delta_vs_dummy").alias("mean_delta_vs_dummy"),
             F.count_if(F.col("delta_vs_dummy") > 0).alias("n_seeds_delta_positive")]
    return per_seed.groupBy(*keys).agg(*aggs)


def comparison_table(cells: DataFrame) -> DataFrame:
    """Per model: mean and population std over (period, seed), mean delta, periods positive."""
    unit = deltas(cells, ["model_family", "period_id", "seed"])
    per = unit.groupBy("model_family", "period_id").agg(F.avg("delta_vs_dummy").alias("_d"))
    pos = per.groupBy("model_family").agg(F.count_if(F.col("_d") > 0).alias("periods_positive"),
                                          F.count("*").alias("n_periods"))
    top = unit.groupBy("model_family").agg(
        F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1"),
        F.avg("delta_vs_dummy").alias("mean_delta_vs_dummy"), F.avg("dummy_macro_f1").alias("dummy_mean_macro_f1"))
    return top.join(pos, "model_family")


def budget_ledger(units: DataFrame, stage: str, events: str) -> DataFrame:
    """Events per stage plus a total row."""
    r = units.rollup(stage).agg(F.sum(events).alias("scoring_events"))
    return r.select(F.coalesce(stage, F.lit("total")).alias("stage_name"), "scoring_events")


def audit_numbers(source: DataFrame, specs: list[tuple[str, str, str, str, float, int, str]], order: list[str] | None = None) -> DataFrame:
    """Declared numbers re-derived from a table and compared as printed.

    A spec is (id, filter, field, aggregate, scale, digits, printed). All specs are conditional
    aggregates of one pass. ``first`` is the first row by ``order``; ``ratio`` takes a field
    ``numerator/denominator`` and divides their sums. Values become decimals before they are scaled, and
    rounding is half-up.
    """
    how = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}

    def derived(where: str, field: str, aggregate: str) -> Column:
        hit = F.expr(where)
        if aggregate == "first":
            if not order:
                raise ValueError("first needs an order")
            return F.min_by(F.col(field), F.when(hit, F.struct(*order)))
        if aggregate == "ratio":
            over, under = (F.sum(F.when(hit, F.col(c.strip()))) for c in field.split("/"))
            return over / F.nullif(under.cast("double"), F.lit(0.0))
        return how[aggregate](F.when(hit, F.col(field)))

    one = source.agg(*[derived(w, f, a).alias(i) for i, w, f, a, *_ in specs])
    rows = F.array(*[F.struct(
        F.lit(i).alias("number_id"),
        F.round(F.col(i).cast("decimal(30,15)") * F.lit(Decimal(str(scale))), digits).cast("double").alias("derived"),
        F.lit(float(printed)).alias("printed")) for i, _, _, _, scale, digits, printed in specs])
    out = one.select(F.explode(rows).alias("_r")).select("_r.*")
    return out.withColumn("status", F.when(F.col("derived").isNull(), "unresolved")
                          .when(F.abs(F.col("derived") - F.col("printed")) < 1e-9, "match").otherwise("mismatch"))


class TextAudit(NamedTuple):
    """A printed text and what it has to hold. ``mode`` is ``date``, ``regex_int`` or ``range``.

    ``how`` (mean, min, max, sum), ``scale``, ``digits``, ``lo`` and ``hi`` belong to ranges, ``pattern`` with one group to
    ``regex_int``.
    """

    number_id: str
    mode: str
    where: str
    field: str
    printed: str
    how: str = "mean"
    pattern: str = ""
    scale: str = "1"
    digits: int = 0
    lo: str = "0"
    hi: str = "0"


def audit_texts(source: DataFrame, specs: list[TextAudit], order: list[str]) -> DataFrame:
    """Dates, whole numbers inside texts and descriptive ranges, re-derived from a table and looked up as printed.

    A date is the trimmed field of the first row by ``order`` and has to be among the printed dates; a ``regex_int`` is
    the pattern's group in that row's field and has to be among the printed numbers. A range holds where the
    rounded aggregate lies within lo and hi and both ends are printed; else it is for ``review``. No row, or
    no match of the pattern, is ``unresolved``. All specs are conditional aggregates of one pass.
    """
    how = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}

    def raw(s: TextAudit) -> Column:
        hit = F.expr(s.where)
        if s.mode == "range":
            return how[s.how](F.when(hit, F.col(s.field))).cast("decimal(30,15)")
        return F.trim(F.min_by(F.col(s.field).cast("string"), F.when(hit, F.struct(*order))))

    def row(s: TextAudit) -> Column:
        printed, none = F.lit(s.printed), F.lit(None)
        numbers = F.regexp_extract_all(printed, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).cast("array<decimal(30,15)>")
        text, value = none.cast("string"), none.cast("double")
        if s.mode == "range":
            lo, hi = (F.lit(Decimal(x)).cast("decimal(30,15)") for x in (s.lo, s.hi))
            rounded = F.round(F.col(s.number_id) * F.lit(Decimal(s.scale)), s.digits)
            ends = F.array_contains(numbers, lo) & F.array_contains(numbers, hi)
            value = rounded.cast("double")
            status = F.when(rounded.isNull(), "unresolved").when(rounded.between(lo, hi) & ends, "match").otherwise("review")
        else:
            if s.mode == "date":
                text = F.col(s.number_id)
                found = F.array_contains(F.regexp_extract_all(printed, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), text)
            elif s.mode == "regex_int":
                text = F.nullif(F.regexp_extract(s.number_id, s.pattern, 1), F.lit(""))
                found = F.array_contains(numbers, text.cast("decimal(30,15)"))
            else:
                raise ValueError(f"unknown audit mode {s.mode}")
            status = F.when(text.isNull(), "unresolved").when(found, "match").otherwise("mismatch")
        return F.struct(F.lit(s.number_id).alias("number_id"), F.lit(s.mode).alias("mode"), text.alias("derived_text"),
                        value.alias("derived"), status.alias("status"))

    one = source.agg(*[raw(s).alias(s.number_id) for s in specs])
    return one.select(F.explode(F.array(*map(row, specs))).alias("_r")).select("_r.*")
