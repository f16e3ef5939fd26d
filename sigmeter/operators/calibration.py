"""Reliability bins, calibration errors and the Brier decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import ratio
from ..session import materialise

SCHEMES = ("equal_width", "equal_mass")


def calibration_views(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Two views per row: the up-probability against y_true, and confidence against correctness."""
    conf = F.greatest(F.col("p_up"), 1.0 - F.col("p_up"))
    correct = (F.col("y_true") == F.col("y_pred")).cast("int")
    views = F.array(F.struct(F.lit("p_up").alias("view"), F.col("p_up").alias("value"), F.col("y_true").alias("outcome")),
                    F.struct(F.lit("top_label_confidence").alias("view"), conf.alias("value"), correct.alias("outcome")))
    return rows.withColumn("_v", F.explode(views)).select(*keep, "y_true", "_v.*")


CELL_BITS = (12, 24)  # cells of the two counting passes over [0, 1]
CROWDED = 1 << 20  # a cell with more rows is counted a second time before its values are
SUMS = ("n", "v", "o", "y", "sq")


def value_sums() -> list[Column]:
    d = F.col("value") - F.col("outcome")
    return [F.count("*").alias("n"), F.sum("value").alias("v"), F.sum("outcome").alias("o"), F.sum("y_true").alias("y"), F.sum(d * d).alias("sq")]


def _cell(bits: int, value: Column | str = "value") -> Column:
    """Cell of a score in [0, 1]; 1 itself is in the last."""
    v = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(0), F.least(F.floor(v * float(1 << bits)), F.lit((1 << bits) - 1))).cast("long")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("_r_" + k))
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*["_r_" + k for k in keys if how == "inner" or how == "left"])


def _located(cells: DataFrame, wanted: DataFrame, group: list[str], within: list[str], place: str) -> DataFrame:
    """For each wanted (group, rank, base) the cell that holds the rank, and the rows before that cell.

    ``cells``: counts ``n`` per (group, within, place); at most a few thousand cells per (group, within).
    """
    run = Window.partitionBy(*group, *within).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    held = cells.select(*group, *within, F.struct(F.sum("n").over(run).alias("c"), F.col("n").alias("n"), F.col(place).alias("p")).alias("_s"))
    held = held.groupBy(*group, *within).agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    j = _on(wanted, held, group + within, "inner")
    hit = F.element_at(F.filter("_a", lambda x: x["c"] > F.col("rank") - F.col("base")), 1)
    return j.withColumn("_h", hit).select(*group, *within, "rank", F.col("_h.p").alias(place), (F.col("base") + F.col("_h.c") - F.col("_h.n")).alias("base"), F.col("_h.n").alias("n"))


def pieces_and_edges(values: DataFrame, group: list[str], bin_counts: list[int], expand=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Sums over pieces of [0, 1] that no bin edge cuts, and the edge arrays per (group, scheme, n_bins).

    Rows are counted into cells; only cells that hold an edge are counted again, finer, and at last by value. So
    equal-mass edges are exact quantiles (linear between two ranks, duplicates dropped), nothing is sorted by row,
    and a row is searched for in no array. ``expand`` maps rows or sums to the groups that they belong to, so that
    pooled groups are sums of their parts. Scores lie in [0, 1].
    """
    probs = sorted({i / n for n in bin_counts for i in range(n + 1)})
    coarse, fine = CELL_BITS
    base = values.select(*group, "value", "outcome", "y_true")
    add = [F.sum(c).alias(c) for c in SUMS]
    one = materialise(expand(base.groupBy(*group, _cell(coarse).alias("_c")).agg(*value_sums())).groupBy(*group, "_c").agg(*add), "coarse-cells")
    sizes = one.groupBy(*group).agg(F.sum("n").alias("total"))
    h = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*[f(h(q)).cast("long") for q in probs for f in (F.floor, F.ceil)]))
    wanted = sizes.select(*group, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("base"))
    at_one = materialise(_located(one, wanted, group, [], "_c"), "rank-cells")
    widths = lambda bits: F.array(*[_cell(bits, F.lit(float(q))) for q in probs])

    def narrowed(at: DataFrame, place: str, bits: int) -> tuple[DataFrame, DataFrame]:
        """The cells that hold a wanted rank or an equal-width edge, and their rows."""
        cut = at.select(*group, place).unionByName(sizes.select(*group, F.explode(widths(bits)).alias(place))).distinct()
        return cut, _on(expand(base.withColumn(place, _cell(bits))), cut, group + [place], "left_semi")

    cut, rows = narrowed(at_one, "_c", coarse)
    parts = [_on(one, cut, group + ["_c"], "left_anti").withColumn("low", F.col("_c") / float(1 << coarse))]
    place, at = "_c", at_one
    if (at_one.agg(F.max("n")).first()[0] or 0) > CROWDED:
        two = materialise(rows.groupBy(*group, "_c", _cell(fine).alias("_f")).agg(*value_sums()), "fine-cells")
        place, at = "_f", materialise(_located(two, at_one.drop("n"), group, ["_c"], "_f"), "rank-cells").drop("_c")
        cut, rows = narrowed(at, "_f", fine)
        parts.append(_on(two, cut, group + ["_f"], "left_anti").withColumn("low", F.col("_f") / float(1 << fine)))
    last = materialise(rows.groupBy(*group, place, "value").agg(*value_sums()), "edge-values")
    parts.append(last.withColumn("low", F.col("value")))
    known = _located(last, at.drop("n"), group, [place], "value").groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    known = _on(known, sizes, group, "inner")
    options = []

    def quantile(q: float) -> Column:
        lo, hi = F.col("_m")[F.floor(h(q)).cast("long")], F.col("_m")[F.ceil(h(q)).cast("long")]
        return lo + (hi - lo) * (h(q) - F.floor(h(q)))

    for n in bin_counts:
        mass = F.array_sort(F.array_distinct(F.array(*[quantile(i / n) for i in range(n + 1)])))
        mass = F.when(F.size(mass) < 2, F.array(mass[0], mass[0])).otherwise(mass)
        width = F.array(*[F.lit(i / n) for i in range(n + 1)])
        for scheme, e in zip(SCHEMES, (width, mass)):
            options.append(F.struct(F.lit(scheme).alias("binning_scheme"), F.lit(n).alias("n_bins"), e.alias("edges")))
    edges = known.select(*group, F.explode(F.array(*options)).alias("_o")).select(*group, "_o.*")
    # An interpolated edge may fall between its two ranks into a cell without rows, or at a value: no piece is cut by it
    # unless both ranks lie in other cells with rows between them, and between neighbouring ranks there are none.
    out = parts[0].select(*group, "low", *SUMS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*group, "low", *SUMS))
    return out, edges


def reliability_bins(cells: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Per bin: bounds, rows, mean prediction, frequency and gap; empty bins do not appear."""
    bin_index = F.greatest(F.lit(0), F.least(
        F.size(F.filter("edges", lambda b: b <= F.col("low"))) - 1, F.size("edges") - 2))
    keys = group + ["binning_scheme", "n_bins"]
    g = cells.join(edges, group).groupBy(*keys, bin_index.alias("bin_index")).agg(
        F.sum("n").alias("n_rows"), F.sum("v").alias("_v"), F.sum("o").alias("_o"))
    g = g.join(edges, keys).select(
        *keys, "bin_index", F.get("edges", F.col("bin_index")).alias("bin_lower"),
        F.get("edges", F.col("bin_index") + 1).alias("bin_upper"), "n_rows",
        ratio("_v", "n_rows").alias("mean_predicted"), ratio("_o", "n_rows").alias("empirical_frequency"))
    return g.withColumn("abs_gap", F.abs(F.col("empirical_frequency") - F.col("mean_predicted")))


def calibration_errors(bins: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n_rows")
    return bins.groupBy(*keys).agg(ratio(F.sum(n * F.col("abs_gap")), F.sum(n)).alias("ece"),
                                   F.max("abs_gap").alias("mce"))


def brier_terms(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Murphy terms from the bins alone; the base rate is the bins' weighted frequency."""
    n, f, m = F.col("n_rows"), F.col("empirical_frequency"), F.col("mean_predicted")
    g = bins.groupBy(*keys).agg(F.sum(n).alias("_n"), F.sum(n * f).alias("_o"), F.sum(n * f * f).alias("_ff"),
                                F.sum(n * (m - f) * (m - f)).alias("_rel"))
    base = ratio("_o", "_n")
    return g.select(*keys, ratio("_rel", "_n").alias("brier_reliability"),
                    (ratio("_ff", "_n") - base * base).alias("brier_resolution"),
                    (base * (1.0 - base)).alias("brier_uncertainty"))


def brier_score(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), ratio(F.sum("v"), F.sum("n")).alias("mean_predicted"),
        ratio(F.sum("y"), F.sum("n")).alias("base_rate_up"), ratio(F.sum("sq"), F.sum("n")).alias("_brier"))


def calibration_frames(rows: DataFrame, bin_counts: list[int], primary: tuple[str, str, int]) -> tuple[DataFrame, DataFrame]:
    """(summary, bins): all seeds x views x schemes x bin counts, tickers for the primary
    combination, and seed means."""
    keys = ["seed", "ticker", "view"]
    views = calibration_views(rows, ["seed", "ticker"])

    def expand(df: DataFrame) -> DataFrame:
        """Every row or sum under 'pooled', those of the primary view also under their ticker."""
        own = F.array_compact(F.array(F.lit("pooled"), F.when(F.col("view") == primary[0], F.col("ticker"))))
        return df.withColumn("ticker", F.explode(own))

    pieces, edges = pieces_and_edges(views, keys, bin_counts, expand)
    edges = materialise(edges, "bin-edges").filter((F.col("ticker") == "pooled") | ((F.col("binning_scheme") == primary[1])
                                                           & (F.col("n_bins") == primary[2])))
    cells = materialise(pieces, "calibration-cells")
    bins = materialise(reliability_bins(cells, edges, keys), "bins")
    combo = keys + ["binning_scheme", "n_bins"]
    summary = (calibration_errors(bins, combo).join(brier_terms(bins, combo), combo)
               .join(brier_score(cells, keys), keys))
    up = F.col("view") == "p_up"
    summary = summary.withColumn("brier_score", F.when(up, F.col("_brier"))).drop("_brier")
    for c in ("brier_reliability", "brier_resolution", "brier_uncertainty"):
        summary = summary.withColumn(c, F.when(up, F.col(c)))
    stats = ["ece", "mce", "brier_score", "brier_reliability", "brier_resolution", "brier_uncertainty",
             "mean_predicted", "base_rate_up"]
    mean = summary.filter("ticker = 'pooled'").groupBy("ticker", "view", "binning_scheme", "n_bins").agg(
        F.sum("n_rows").alias("n_rows"), *[F.avg(c).alias(c) for c in stats])
    out = summary.withColumn("seed", F.col("seed").cast("string")).unionByName(mean.withColumn("seed", F.lit("seed_mean")))
    return out, bins.filter("ticker = 'pooled'").drop("ticker")
