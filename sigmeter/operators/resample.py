"""Block bootstrap, label-shuffle and reversal controls, small-sample bounds, PBO.

Resampling never touches rows: blocks ((ticker, trading_day) of a slice) are reduced to integer
sums once, and every draw works on those. A bootstrap task expands one index range of blocks for one
chunk of draws down the splitting tree and multiplies counts by block sums, so no pick is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions import confusion as C
from ..functions.hypergeom import shuffled_true_positives
from ..functions.scalar import hex01, key_hex
from ..functions.splitting import multiplicities
from ..functions.student_t import lcb_agg
from ..session import materialise, ship_package, spread
from .ranks import global_position
from .readouts import BLOCK

RANGE_HEIGHT = 10  # a task expands 2**RANGE_HEIGHT blocks ...
DRAW_CHUNK = 250  # ... for this many draws at once


def index_blocks(blocks: DataFrame, slices: list[str], block: list[str] = BLOCK) -> DataFrame:
    """Dense 0-based index of each slice's blocks in the order of their key hash, and the count.

    The hash also buckets the blocks (3 hex digits), so ranks are taken inside even buckets and
    shifted by the few bucket totals: no slice's blocks meet in one task.
    """
    b = blocks.withColumn("_h", key_hex(*[F.col(c) for c in block])).withColumn("_k", F.substring("_h", 1, 3))
    sizes = b.groupBy(*slices, "_k").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*slices)
    # at most 4,096 buckets per slice
    sizes = sizes.select(*slices, "_k", F.sum("_n").over(w).alias("n_blocks"),
                         (F.sum("_n").over(w.orderBy("_k")) - F.col("_n")).alias("_o"))
    inner = Window.partitionBy(*slices, "_k").orderBy("_h")
    out = b.withColumn("_i", F.row_number().over(inner) - 1).join(sizes, slices + ["_k"])
    return out.withColumn("idx", F.col("_i") + F.col("_o")).drop("_h", "_k", "_i", "_o")


def dealt(idx: DataFrame, slices: list[str], n_boot: int) -> DataFrame:
    """Indexed blocks by (slice, range, chunk of draws): what a task expands. The tasks multiply their rows, so
    their number is explicit and adaptive execution leaves it."""
    chunks = -(-n_boot // DRAW_CHUNK)
    x = idx.withColumn("_range", F.shiftright("idx", RANGE_HEIGHT)).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread(x, *slices, "_range", "_chunk")


def bootstrap_draws(blocks: DataFrame, slices: list[str], values: list[str], n_boot: int, seed: int,
                    block: list[str] = BLOCK) -> DataFrame:
    """Sums of ``values`` per (slice, draw): n_blocks picks with replacement per draw.

    Each range of blocks gives one row per draw, whatever its blocks; nothing is broadcast or joined.
    """
    ship_package(blocks.sparkSession)
    rest = [b for b in block if b not in slices]
    idx = materialise(index_blocks(blocks.select(*slices, *rest, *values), slices, block).drop(*rest), "blocks")
    kinds = {f.name: f.dataType for f in idx.schema}
    whole = {v: isinstance(kinds[v], (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for v in values}

    def expand(rows: pa.Table) -> pa.Table:
        at = rows["_range"][0].as_py() << RANGE_HEIGHT
        n, chunk = rows["n_blocks"][0].as_py(), rows["_chunk"][0].as_py()
        draws = np.arange(chunk * DRAW_CHUNK, min((chunk + 1) * DRAW_CHUNK, n_boot))
        counts = multiplicities(seed, draws, n, at, RANGE_HEIGHT)[:, np.asarray(rows["idx"]) - at]
        out = {c: pa.array([rows[c][0].as_py()] * len(draws), rows.schema.field(c).type) for c in slices}
        out["draw"] = pa.array(draws)
        for v in values:
            x = np.asarray(rows[v].combine_chunks().fill_null(0))
            out[v] = pa.array(counts @ x)
        out["n_blocks"] = pa.array(np.full(len(draws), n))
        return pa.table(out)

    schema = T.StructType([T.StructField(c, kinds[c]) for c in slices] + [T.StructField("draw", T.LongType())] +
                          [T.StructField(v, T.LongType() if whole[v] else T.DoubleType()) for v in values] + [T.StructField("n_blocks", T.LongType())])
    idx = idx.withColumns({"idx": F.col("idx").cast("long"), "n_blocks": F.col("n_blocks").cast("long")} | {v: F.col(v).cast("long" if whole[v] else "double") for v in values})
    parts = dealt(idx, slices, n_boot).groupBy(*slices, "_range", "_chunk").applyInArrow(expand, schema)
    return parts.groupBy(*slices, "draw").agg(*[F.sum(v).alias(v) for v in values], F.max("n_blocks").alias("n_blocks"))


def block_bootstrap(cells: DataFrame, slices: list[str], n_boot: int = 1000, seed: int = 12345) -> DataFrame:
    """Per slice: point delta, bootstrap mean, 2.5 and 97.5 percentiles and block count.

    F1 is recomputed from each draw's summed counts. One block returns the point.
    """
    keys = list(dict.fromkeys([*slices, *BLOCK]))
    blocks = materialise(cells.groupBy(*keys).agg(*C.resum()), "block-sums")  # read for the draws and for the point
    draws = bootstrap_draws(blocks, slices, ["n", "p", "pp", "tp", "bp", "btp"], n_boot, seed)
    d = draws.select(*slices, "n_blocks", C.delta_f1().alias("_d"))
    ci = d.groupBy(*slices).agg(F.avg("_d").alias("mean"), F.percentile("_d", 0.025).alias("lcb"),
                                F.percentile("_d", 0.975).alias("ucb"), F.max("n_blocks").alias("n_blocks"))
    point = blocks.groupBy(*slices).agg(*C.resum()).select(*slices, C.delta_f1().alias("point"))
    return point.join(ci, slices).select(*slices, "point", "mean", "lcb", "ucb", "n_blocks")


def minimum_detectable_effect(ci: DataFrame) -> DataFrame:
    return ci.withColumns({"mde": F.col("mean") - F.col("lcb"), "mde_symmetric": (F.col("ucb") - F.col("lcb")) / 2,
                           "clears_zero": F.col("lcb") > 0})


def bootstrap_mean_lcb(block_values: DataFrame, slices: list[str], n_boot: int, seed: int) -> DataFrame:
    """2.5 percent bound of the bootstrap mean of per-block values (already averaged per block)."""
    b = materialise(block_values, "block-values").withColumn("one", F.lit(1))  # read for the sizes and for the places
    draws = bootstrap_draws(b, slices, ["value", "one"], n_boot, seed)
    m = draws.select(*slices, "n_blocks", (F.col("value") / F.col("one")).alias("_m"))
    return m.groupBy(*slices).agg(F.percentile("_m", 0.025).alias("lcb"), F.avg("_m").alias("mean"),
                                  F.max("n_blocks").alias("n_blocks"))


def shuffled_counts(blocks: DataFrame, keep: list[str], n_perm: int, seed: int) -> DataFrame:
    """True positives of model and baseline under a label shuffle, per (keep, block, draw).

    Cost is draws x blocks; each draw is keyed by (seed, draw, block).
    """
    x = spread(blocks, "seed", *BLOCK).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).withColumn(
        "_h", key_hex(F.lit(seed), F.col("draw"), F.col("seed"), *[F.col(b) for b in BLOCK]))
    x = x.withColumn("_t", shuffled_true_positives(*[hex01(F.col("_h"), i) for i in (1, 14, 27)]))
    return x.select(*keep, "draw", "n", "p", "pp", "bp", "_t.tp", "_t.btp")


def label_shuffle(cells: DataFrame, slices: list[str], n_perm: int = 200, seed: int = 20260617) -> DataFrame:
    """Null of the same-row delta: mean, sd, p95 and the add-one p-value, per slice."""
    blocks = materialise(cells.groupBy(*slices, *BLOCK).agg(*C.resum()), "shuffle-blocks")
    per = shuffled_counts(blocks, slices, n_perm, seed).groupBy(*slices, "draw").agg(
        *[F.sum(c).alias(c) for c in ("n", "p", "pp", "bp", "tp", "btp")])
    null = per.select(*slices, C.delta_f1().alias("_d"))
    obs = blocks.groupBy(*slices).agg(*C.resum(), F.count("*").alias("n_blocks")).select(
        *slices, "n_blocks", F.col("n").alias("n_rows"), C.delta_f1().alias("observed_delta"))
    j = null.join(obs, slices)  # n_perm rows per slice against one
    return j.groupBy(*slices).agg(
        F.max("n_rows").alias("n_rows"), F.max("n_blocks").alias("n_blocks"), F.max("observed_delta").alias("observed_delta"),
        F.avg("_d").alias("label_shuffle_mean"), F.stddev_samp("_d").alias("label_shuffle_sd"),
        F.percentile("_d", 0.95).alias("label_shuffle_p95"),
        ((1 + F.count_if(F.col("_d") >= F.col("observed_delta"))).cast("double") / (n_perm + 1)).alias("label_shuffle_p_value"))


WORD_BITS = 6  # a word holds a bit each of 2**WORD_BITS neighbouring positions


def _moved(word: Column, by: Column) -> Column:
    """The word with its bits moved up, or down where ``by`` is negative, by fewer than 64 places."""
    return F.when(by >= 0, F.call_function("shiftleft", word, by)).otherwise(F.call_function("shiftrightunsigned", word, -by))


def reversed_sums(rows: DataFrame, slices: list[str], order: tuple[str, ...] = ("target_timestamp", "sample_id")) -> DataFrame:
    """Sums of ``row_sums`` but q11 per slice, with y_pred reversed inside each block. Labels and predictions are 0, 1 or null.

    Rows get a global position in block order; a row's mirror is at start + end - position. Only tp depends on it, so no
    row is joined to another: tasks pack the labels of 64 neighbouring positions into a word and their predictions, back
    to front, into another. The second lies across two words of its block, and bits that meet there are counted.
    """
    keys = slices + BLOCK
    p = global_position(rows.select(*keys, *order, "y_true", "y_pred", "base_pred"),
                        [F.col(k).asc() for k in keys] + [F.col(o).asc() for o in order], order)
    last = (1 << WORD_BITS) - 1
    at = F.col("pos").bitwiseAND(last).cast("int")
    bits = lambda c, place: F.bit_or(_moved(F.coalesce(F.col(c).cast("long"), F.lit(0)), place))
    own = ["n", "p", "pp", "bp", "btp"]
    words = p.groupBy(*keys, F.shiftright("pos", WORD_BITS).alias("_w")).agg(
        bits("y_true", at).alias("_y"), bits("y_pred", last - at).alias("_back"), F.min("pos").alias("_first"), F.max("pos").alias("_last"),
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p"), F.sum("y_pred").alias("pp"), F.sum("base_pred").alias("bp"),
        F.sum(F.col("y_true") * F.col("base_pred")).alias("btp"))
    words = materialise(words, "mirror-words")  # read for the ends of blocks and for the bits
    ends = words.groupBy(*keys).agg((F.min("_first") + F.max("_last")).alias("_ends"))
    # The word's mirror begins at _to: its bits move up by _to mod 64, and those past the word's end belong to the next.
    x = words.join(ends, keys).withColumn("_to", F.col("_ends") - F.shiftleft("_w", WORD_BITS) - last)
    up = F.col("_to").bitwiseAND(last).cast("int")
    none, at = F.lit(0).cast("long"), F.shiftright("_to", WORD_BITS)
    over = F.when(up > 0, _moved(F.col("_back"), up - last - 1)).otherwise(none)
    piece = lambda w, y, back, mine: F.struct(w.alias("_w"), y.alias("_y"), back.alias("_back"), *[(F.col(c) if mine else F.lit(None)).cast("long").alias(c) for c in own])
    pieces = F.array(piece(F.col("_w"), F.col("_y"), none, True), piece(at, none, _moved(F.col("_back"), up), False), piece(at + 1, none, over, False))
    # _ends rises from block to block, so it names the block.
    met = x.select(*slices, "_ends", F.explode(pieces).alias("_p")).select(*slices, "_ends", "_p.*").groupBy(*slices, "_ends", "_w").agg(
        F.bit_count(F.bit_or("_y").bitwiseAND(F.bit_or("_back"))).alias("tp"), *[F.sum(c).alias(c) for c in own])
    return met.groupBy(*slices).agg(*[F.sum(c).alias(c) for c in ["n", "p", "pp", "tp", "bp", "btp"]])


def time_reverse(rows: DataFrame, slices: list[str], order: tuple[str, ...] = ("target_timestamp", "sample_id")) -> DataFrame:
    """Delta with y_pred reversed inside each block."""
    return reversed_sums(rows, slices, order).select(*slices, C.delta_f1().alias("time_reverse_delta"))


def family_cis(per_family: DataFrame, keys: list[str]) -> DataFrame:
    cols = [F.min("lcb").alias("min_family_lcb"), F.median("lcb").alias("median_family_lcb"),
            F.max("mean").alias("max_family_mean")]
    return per_family.groupBy(*keys).agg(*cols) if keys else per_family.agg(*cols)


MAX_BLOCKS = 24


def cscv_splits(matrix: DataFrame, trial: str = "trial", block: str = "block", perf: str = "perf",
                is_block_count: int | None = None) -> DataFrame:
    """One row per in-sample split: out-of-sample rank logit of the in-sample winner.

    Splits are bit masks over the block index; trials and blocks are configured rosters (a
    handful), so the split table is small by construction. Incomplete rosters give no rows.
    """
    every = Window.partitionBy()
    m = matrix.select(
        (F.dense_rank().over(Window.orderBy(trial)) - 1).alias("_t"), (F.dense_rank().over(Window.orderBy(block)) - 1).alias("_b"),
        F.col(perf).cast("double").alias("_v"))
    m = m.withColumns({"n_trials": F.max("_t").over(every) + 1, "n_blocks": F.max("_b").over(every) + 1,
                       "_cells": F.count("_v").over(every)})
    m = m.filter((F.col("n_trials") >= 2) & (F.col("n_blocks") >= 2) & (F.col("_cells") == F.col("n_trials") * F.col("n_blocks")))
    k = F.floor(F.col("n_blocks") / 2) if is_block_count is None else F.lit(is_block_count)
    k = F.greatest(F.lit(1), F.least(k, F.col("n_blocks") - 1)).cast("int")
    m = m.withColumn("_k", k)
    # Masks are rows made from two halves of the bits, so no array holds them all.
    low = F.floor(F.col("n_blocks") / 2).cast("int")
    ones = lambda n: F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1)
    few = F.when(F.col("n_blocks") > MAX_BLOCKS, F.raise_error(F.lit(f"more than {MAX_BLOCKS} blocks: too many splits to enumerate"))).otherwise(low)
    splits = m.select("n_blocks", "_k").distinct().withColumn("_high", F.explode(ones((F.col("n_blocks") - low).cast("int")))).withColumn("_low", F.explode(ones(few.cast("int"))))
    mask = F.call_function("shiftleft", F.col("_high"), low).bitwiseOR(F.col("_low"))
    splits = splits.select("n_blocks", "_k", mask.alias("_mask")).filter(F.bit_count("_mask") == F.col("_k"))
    x = m.join(splits, ["n_blocks", "_k"])
    inside = F.getbit(F.col("_mask"), F.col("_b").cast("int")) == 1
    t = x.groupBy("_mask", "_t", "n_trials", "n_blocks", "_k").agg(
        F.avg(F.when(inside, F.col("_v"))).alias("_is"), F.avg(F.when(~inside, F.col("_v"))).alias("_os"))
    by = Window.partitionBy("_mask").orderBy("_os")
    ties = F.count("*").over(Window.partitionBy("_mask", "_os"))
    t = t.withColumn("_rank", F.rank().over(by) + (ties - 1) / 2.0)
    w = t.groupBy("_mask", "n_trials", "n_blocks", "_k").agg(
        F.max_by("_rank", F.struct(F.col("_is"), -F.col("_t"))).alias("_rank"))
    omega = F.least(F.greatest(F.col("_rank") / (F.col("n_trials") + 1), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return w.select(F.col("_mask").alias("split_mask"), "n_trials", "n_blocks", F.col("_k").alias("is_block_count"),
                    F.log(omega / (1 - omega)).alias("logit"))


def cscv_pbo(matrix: DataFrame, **kw) -> DataFrame:
    s = cscv_splits(matrix, **kw)
    return s.agg((F.count_if(F.col("logit") < 0).cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("pbo"),
                 F.count("*").alias("n_combinations"), F.max("n_trials").alias("n_trials"), F.max("n_blocks").alias("n_blocks"),
                 F.max("is_block_count").alias("is_block_count"),
                 (F.max("n_blocks") - F.max("is_block_count")).alias("os_block_count"),
                 (F.max("n_blocks") == 2 * F.max("is_block_count")).alias("is_symmetric"),
                 F.median("logit").alias("median_logit"))


def metric_lcb(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(lcb_agg(F.col(value)).alias("lcb"), F.avg(value).alias("mean"),
                                 F.count(value).alias("n_values"))
