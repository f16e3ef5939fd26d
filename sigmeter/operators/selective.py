"""Risk-coverage curves: whole, on a coverage grid, and their bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import confusion as C
from ..functions.scalar import harmonic, harmonic_numbers, harmonic_series, ratio
from ..session import spread
from .ranks import confidence_rank, prefix_sums

# Fixed coverage grid.
GRID_MIN, GRID_STEP, GRID_SIZE = 0.05, 0.005, 191


def with_confidence(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, "sample_id", "y_true", "y_pred",
                       F.greatest(F.col("p_up"), 1.0 - F.col("p_up")).alias("confidence"),
                       (F.col("y_true") == F.col("y_pred")).cast("int").alias("correct"))


def risk_coverage_curve(ranked: DataFrame, group: list[str]) -> DataFrame:
    c = prefix_sums(ranked, group, {"_correct": F.col("correct")})
    acc = ratio("_correct", "rk")
    return c.select(*group, ratio("rk", "group_n").alias("coverage"), F.col("rk").alias("n_covered"),
                    F.col("confidence").alias("confidence_at_coverage"), (1.0 - acc).alias("selective_risk"),
                    acc.alias("selective_accuracy"))


def covered(i: Column, n: Column) -> Column:
    c = F.lit(GRID_MIN) + i * F.lit(GRID_STEP)
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.round(c * n, 9)))).cast("long")


def grid_cell(rk: Column, n: Column) -> Column:
    """Smallest grid index whose prefix holds rank ``rk``; the guess is checked both ways."""
    guess = F.ceil((rk / n - F.lit(GRID_MIN)) / F.lit(GRID_STEP)).cast("int")
    g = F.greatest(F.lit(0), F.least(guess, F.lit(GRID_SIZE - 1)))
    g = F.when((g > 0) & (covered(g - 1, n) >= rk), g - 1).otherwise(g)
    return F.when(covered(g, n) < rk, g + 1).otherwise(g)


def selective_grid(ranked: DataFrame, group: list[str]) -> DataFrame:
    """The curve on the grid with the prefix macro-F1: rows collapse to 191 cells per group first."""
    cells = ranked.withColumn("_i", grid_cell(F.col("rk"), F.col("group_n"))).groupBy(*group, "_i").agg(
        *C.row_sums(base=None), F.sum("correct").alias("_c"), F.min("confidence").alias("_conf"))
    sizes = ranked.groupBy(*group).agg(F.max("group_n").alias("_total"))
    grid = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))))
    run = Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    j = grid.join(cells, group + ["_i"], "left")
    sums = {c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in ("n", "p", "pp", "tp", "_c")}
    j = j.withColumns({**sums, "_conf": F.min("_conf").over(run)})
    acc = ratio("_c", "n")
    return j.select(*group, ratio("n", "_total").alias("coverage"), F.col("n").alias("n_covered"),
                    F.col("_conf").alias("confidence_at_coverage"), (1.0 - acc).alias("selective_risk"),
                    acc.alias("selective_accuracy"), C.macro_f1().alias("selective_macro_f1"))


RANK_BLOCK = 1 << 14  # ranks a bootstrap task holds at once


def resampled_curves(ranked: DataFrame, n_boot: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Exact risk curves under whole-day resampling, per (seed, draw): the curve at the grid, and its sums.

    A draw repeats every row as often as its day is picked and keeps the ranking. Ranks are cut into blocks: a
    first pass gives what each block covers and errs in a draw, from its rows per day; running sums over the
    blocks give where it starts, and a second pass interpolates the grid points that fall into the block, for
    the draws that have one there. The mean risk over all prefixes needs harmonic numbers at error rows only: m
    copies of an error after c covered rows add m H(M) - G(c + m) + G(c) with G(n) = n H(n) - n, summed by
    row near the start and by ``_smooth_area`` from ``SMOOTH_FROM`` on. Day counts come from the splitting tree in every
    task, which takes a block with all draws.

    Returns (seed, draw, grid_index, risk) and (seed, draw, covered, errors, aurc, oracle_aurc).
    """
    from ..functions.splitting import day_table
    from ..session import materialise, ship_package
    from .resample import index_blocks

    spark = ranked.sparkSession
    ship_package(spark)
    days = index_blocks(ranked.select("trading_day").distinct(), [], ["trading_day"]).select("trading_day", F.col("idx").alias("_d"))
    rows = ranked.select("seed", "trading_day", "rk", (1 - F.col("correct")).alias("_e")).join(days, "trading_day")
    rows = materialise(rows.select("seed", F.floor((F.col("rk") - 1) / RANK_BLOCK).cast("long").alias("_b"), "rk", F.col("_d").cast("long").alias("_d"),
                                   F.col("_e").cast("int").alias("_e")), "day-ranks")
    n_days = days.count()
    kind = rows.schema["seed"].dataType.simpleString()
    keys = ["seed", "_b"]
    blocks = spread(rows, *keys).groupBy(*keys)

    def totals(part: pa.Table) -> pa.Table:
        day, wrong = _by_rank(part)
        per_day = np.stack([np.bincount(day, minlength=n_days), np.bincount(day[wrong], minlength=n_days)]).astype(float)
        both = np.concatenate([per_day @ day_table(seed, a, b, n_days) for a, b in _chunks(n_boot)], 1).astype(np.int64)
        return pa.table({"seed": pa.array([part["seed"][0].as_py()] * n_boot, part.schema.field("seed").type), "_b": np.full(n_boot, part["_b"][0].as_py()),
                         "draw": np.arange(n_boot), "c": both[0], "e": both[1]})

    sums = materialise(blocks.applyInArrow(totals, f"seed {kind}, _b long, draw long, c long, e long"), "rank-blocks")
    before = Window.partitionBy("seed", "draw").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("seed", "draw")
    offsets = sums.select("seed", "_b", "draw", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"),
                          F.sum("c").over(whole).alias("covered"), F.sum("e").over(whole).alias("errors"))
    offsets = materialise(offsets, "rank-offsets")

    def curve(part: pa.Table, starts: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        if not part.num_rows or not starts.num_rows:
            return pa.table({"seed": pa.array([], part.schema.field("seed").type), "draw": pa.array([], pa.int64()), "grid_index": pa.array([], pa.int64()), "risk": pa.array([], pa.float64())})
        starts = starts.sort_by("draw")
        day, wrong = _by_rank(part)
        at = {c: np.asarray(starts[c].combine_chunks()) for c in ("c", "c0", "e0", "covered")}
        draw, index, risk = [], [], []
        for first, last in _chunks(n_boot):
            table, (c, c0, e0, all_c) = day_table(seed, first, last, n_days), (x[first:last] for x in at.values())
            held = _holds_grid_point(c, c0, all_c)
            d, g, r = _interpolated(table[:, held].T[:, day].astype(np.int64), wrong, c0[held], e0[held], all_c[held])
            if c0.min() < SMOOTH_FROM:
                area = _error_area(table.T[:, day].astype(np.int64), wrong, c0, all_c)
            else:
                area = _smooth_area(table, day, wrong, c0, all_c)
            draw += [first + held[d], np.arange(first, last)]
            index += [g, np.full(last - first, -1)]
            risk += [r, area]
        draw = np.concatenate(draw)
        return pa.table({"seed": pa.array([part["seed"][0].as_py()] * len(draw), part.schema.field("seed").type), "draw": draw,
                         "grid_index": np.concatenate(index), "risk": np.concatenate(risk)})

    points = blocks.cogroup(spread(offsets, *keys).groupBy(*keys)).applyInArrow(curve, f"seed {kind}, draw long, grid_index long, risk double")
    points = materialise(points, "risk-points")
    ends = offsets.groupBy("seed", "draw").agg(F.max("covered").alias("covered"), F.max("errors").alias("errors"))
    area = points.filter("grid_index < 0").groupBy("seed", "draw").agg(F.sum("risk").alias("_a"))
    n, e = F.col("covered"), F.col("errors")
    good = n - e
    scalars = ends.join(area, ["seed", "draw"]).select("seed", "draw", "covered", "errors", (F.col("_a") / n).alias("aurc"),
                                                       ((e - good * (harmonic(n) - harmonic(good))) / n).alias("oracle_aurc"))
    return points.filter("grid_index >= 0"), scalars


def _chunks(n_boot: int) -> list[tuple[int, int]]:
    """First and last draw of each chunk of draws."""
    from .resample import DRAW_CHUNK

    return [(a, min(a + DRAW_CHUNK, n_boot)) for a in range(0, n_boot, DRAW_CHUNK)]


def _by_rank(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Day of each row of a block, and whether it errs, in rank order."""
    order = np.argsort(np.asarray(part["rk"].combine_chunks()), kind="stable")
    return np.asarray(part["_d"].combine_chunks())[order], np.asarray(part["_e"].combine_chunks())[order].astype(bool)


def _holds_grid_point(c: np.ndarray, c0: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """The draws of which a grid point lies between the last row before the block and its last row."""
    grid = GRID_MIN + np.arange(GRID_SIZE) * GRID_STEP
    first, last = c0 / covered, (c0 + c) / covered
    ends = np.where(c0 + c == covered, GRID_SIZE, np.searchsorted(grid, last))
    return np.flatnonzero((c > 0) & (np.searchsorted(grid, first) < ends))


def _interpolated(counts: np.ndarray, wrong: np.ndarray, c0: np.ndarray, e0: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(draw, grid index, risk) of the grid points between the last row before the block and its last row."""
    grid = GRID_MIN + np.arange(GRID_SIZE) * GRID_STEP
    out = []
    for i in range(len(counts)):
        seen = np.flatnonzero(counts[i])
        if not len(seen):
            continue
        c = c0[i] + np.cumsum(counts[i][seen])
        y = (e0[i] + np.cumsum((counts[i] * wrong)[seen])) / c
        x = c / covered[i]
        first, last = c0[i] / covered[i], x[-1]
        here = (grid >= first) & ((grid < last) | (c[-1] == covered[i]))
        if c0[i]:
            x, y = np.concatenate([[first], x]), np.concatenate([[e0[i] / c0[i]], y])
        at = np.flatnonzero(here)
        out.append((np.full(len(at), i), at, np.interp(grid[at], x, y)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out))


def _error_area(counts: np.ndarray, wrong: np.ndarray, c0: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Sum over the prefixes of a draw of their risk, as far as the block's errors make it."""
    rows = np.flatnonzero(wrong)
    ends = (c0[:, None] + np.cumsum(counts, 1))[:, rows]
    m = counts[:, rows]
    return (m * harmonic_numbers(covered)[:, None] - _harmonic_sum(ends) + _harmonic_sum(ends - m)).sum(1)


SMOOTH_FROM = 1 << 17  # covered rows from which harmonic numbers are expanded
SMOOTH_ROWS = 256  # ranks of one expansion


def _smooth_area(table: np.ndarray, day: np.ndarray, wrong: np.ndarray, c0: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """As ``_error_area``, by expanding H to second order around the middle of every ``SMOOTH_ROWS`` ranks.

    Every row counts with its own place. With w rows covered around x the next terms are (w / 2x)^3 / 3 with changing
    signs and (w / 2x)^4 / 4, below 1e-9 and 1e-12 of a row at ``SMOOTH_FROM`` and falling with the cube of x.
    """
    top, base, out = harmonic_numbers(covered), c0.astype(float), np.zeros(len(c0))
    for a in range(0, len(day), SMOOTH_ROWS):
        m = table[day[a:a + SMOOTH_ROWS]]
        ends = np.cumsum(m, 0)
        c = ends[-1].copy()
        bad = wrong[a:a + SMOOTH_ROWS]
        m, y = m[bad], ends[bad]
        y *= 2
        y -= m
        y -= c  # twice the distance of a run's middle from the middle of all
        t = m * y
        x = base + (c - 1) / 2
        out += m.sum(0) * (top - harmonic_series(x)) - (1 / x - 1 / (2 * x**2) + 1 / (6 * x**3)) * t.sum(0) / 2 + (1 / x**2 - 1 / x**3) * np.einsum("rd,rd->d", t, y) / 8
        base += c
    return out


def _harmonic_sum(n: np.ndarray) -> np.ndarray:
    return n * harmonic_numbers(n) - n


def bootstrap_bands(points: DataFrame, scalars: DataFrame) -> DataFrame:
    """Pointwise 95 percent bands of the mean-over-seeds risk curve and of its gain over full coverage, in points."""
    full = scalars.groupBy("draw").agg(F.avg(ratio("errors", "covered")).alias("_full"))
    v = points.groupBy("draw", "grid_index").agg(F.avg("risk").alias("risk")).join(full, "draw")
    v = v.withColumn("delta", (F.col("_full") - F.col("risk")) * 100)
    band = [F.percentile(c, q).alias(f"{c}_{e}") for c in ("risk", "delta") for e, q in (("lo", 0.025), ("hi", 0.975))]
    return v.groupBy("grid_index").agg(*band, F.avg("risk").alias("risk_mean"))


def scalar_intervals(scalars: DataFrame) -> DataFrame:
    """95 percent intervals of AURC, its difference to full risk, excess AURC, gap closed and relative excess."""
    m = scalars.groupBy("draw").agg(F.avg("aurc").alias("a"), F.avg("oracle_aurc").alias("o"), F.avg(ratio("errors", "covered")).alias("f"))
    a, o, f = F.col("a"), F.col("o"), F.col("f")
    parts = {"aurc": a, "delta": a - f, "e_aurc": a - o, "gap": ratio(f - a, f - o), "rel": ratio(a - o, f - o)}
    v = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), x.alias("x")) for k, x in parts.items()])).alias("s")).select("s.*")
    return v.groupBy("statistic").agg(F.percentile("x", 0.025).alias("lo"), F.percentile("x", 0.975).alias("hi"), F.count("x").alias("n_draws"))


def permutation_band(rows: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """Band of the mean-over-seeds risk curve under a random ranking common to all seeds.

    A prefix of a random order holds a hypergeometric number of the samples that are wrong for all
    seeds, of those wrong for all but one, and so on, so a draw walks the grid on these counts instead
    of all rows. Every sample has a row per seed; the number of seeds is a configured handful.
    """
    from ..functions.hypergeom import random_prefix_errors
    from ..functions.scalar import hex01, key_hex

    n_seeds = max(1, rows.select("seed").distinct().count())
    per = rows.groupBy("sample_id").agg(F.sum(1 - F.col("correct")).alias("_wrong"))
    c = per.agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("_wrong") == k) for k in range(n_seeds, 0, -1)]).alias("wrong"))
    spark = rows.sparkSession
    draws = spark.range(n_perm, numPartitions=spark.sparkContext.defaultParallelism).withColumnRenamed("id", "draw")
    draws = draws.crossJoin(F.broadcast(c))  # one row of counts
    steps = F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))

    def uniform(level: int) -> Column:
        return F.transform(steps, lambda i: hex01(key_hex(F.lit(seed), F.col("draw"), i, F.lit(level // 4)), 1 + 13 * (level % 4)))

    uniforms = F.flatten(F.array(*[uniform(k) for k in range(n_seeds)]))
    curve = random_prefix_errors(F.transform(steps, lambda i: covered(i, F.col("n"))), uniforms)
    v = draws.select("draw", F.posexplode(curve).alias("grid_index", "risk"))
    return v.groupBy("grid_index").agg(F.percentile("risk", 0.025).alias("risk_lo"), F.percentile("risk", 0.975).alias("risk_hi"),
                                       F.avg("risk").alias("risk_mean"))


def selective_autopsy(rows: DataFrame, day_terciles: DataFrame, block_sums: DataFrame, n_boot: int, boot_seed: int) -> DataFrame:
    """Per tercile (and all) x seed: metrics, the AURC set and the bootstrap's detectable effect."""
    from ..session import materialise
    from .ranks import selective_summary
    from .resample import block_bootstrap
    from .slices import tercile_cells

    t = with_confidence(rows, ["seed", "ticker", "trading_day"]).join(day_terciles, ["ticker", "trading_day"])
    t = t.select("seed", "sample_id", "confidence", "correct", F.explode(F.array(F.lit("all"), F.col("activity_tercile"))).alias("activity_tercile"))
    keys = ["activity_tercile", "seed"]
    s = selective_summary(confidence_rank(t, keys, keep_tie=False), keys).drop("oracle_aurc")
    tc = materialise(tercile_cells(block_sums), "tercile-cells")
    m = tc.groupBy(*keys).agg(*C.resum()).select(*keys, C.macro_f1().alias("macro_f1"), C.accuracy().alias("accuracy"), C.delta_f1().alias("delta_vs_dummy"))
    ci = block_bootstrap(tc, keys, n_boot, boot_seed).select(*keys, "lcb")
    per = s.join(m, keys).join(ci, keys).select(
        "activity_tercile", F.col("seed").cast("string").alias("seed"), "n_rows", "macro_f1", "accuracy", "aurc", "e_aurc", "augrc", "full_coverage_risk",
        "delta_vs_dummy", (F.col("delta_vs_dummy") - F.col("lcb")).alias("mde_vs_dummy"), (F.col("lcb") > 0).alias("delta_clears_mde"))
    stats = ["macro_f1", "accuracy", "aurc", "e_aurc", "augrc", "full_coverage_risk", "delta_vs_dummy", "mde_vs_dummy"]
    mean = per.groupBy("activity_tercile").agg(F.round(F.avg("n_rows")).cast("long").alias("n_rows"), *[F.avg(c).alias(c) for c in stats])
    mean = mean.withColumn("seed", F.lit("seed_mean")).withColumn("delta_clears_mde", F.col("delta_vs_dummy") > F.col("mde_vs_dummy"))
    return per.unionByName(mean)
