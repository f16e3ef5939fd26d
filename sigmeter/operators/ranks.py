"""Exact global ranks without a single-task window.

A window ordered over a whole group puts that group on one task, and ties can defeat any
bucketing by value. Instead the rows are range-partitioned on the full sort key (group, key,
tie: unique, so a hot group or a run of ties splits freely), sorted, and written once to the
shared folder. Parquet gives each row its index in its file; the file sizes give the offsets.
The written table also cuts lineage, so lost executors cost no re-sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import harmonic, ratio
from ..session import materialise, scratch_path, ship_package


def global_position(df: DataFrame, order: list[Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``pos`` (0-based) in the order given; the order must be total. Columns of ``drop`` only order, and are not written."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    # No partition count: adaptive execution merges neighbouring ranges to sensible file sizes.
    df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop).write.parquet(path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_f"),
                                           F.col("_metadata.row_index").alias("_i"))
    sizes = rows.groupBy("_f").agg(F.count("*").alias("_n"))
    # Spark numbers the files in range order; past 100,000 files the names no longer sort like the numbers.
    before = Window.orderBy(file_number(F.col("_f"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    # one row per written file, at most spark.sql.shuffle.partitions
    return rows.join(F.broadcast(offsets), "_f").withColumn(
        "pos", F.col("_o") + F.col("_i")).drop("_f", "_i", "_o")


def file_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def join_on_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null group keys meet each other."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_right_{k}" for k in keys])


def group_rank(df: DataFrame, group: list[str], order: list[Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rk`` (1-based rank in the group) and ``group_n``; without the columns of ``drop``."""
    p = global_position(df, [F.col(g) for g in group] + order, drop)
    starts = p.groupBy(*group).agg(F.min("pos").alias("_start"), F.count("*").alias("group_n"))
    # Written first so that its size is known when the join is planned.
    starts = materialise(starts, "group-starts")
    return join_on_groups(p, starts, group).withColumn("rk", F.col("pos") - F.col("_start") + 1).drop("pos", "_start")


CELL_SHIFT = 46  # a cell of scores shares sign, exponent and the first 6 bits of the fraction
PACK_ROWS = 1 << 20  # rows that a task packs at once


def _ordered(score: pa.ChunkedArray) -> np.ndarray:
    """Unsigned keys in the order of the scores: null below all, NaN above all, both zeros alike."""
    x = np.array(score.fill_null(0.0), float) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.uint64)
    key = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return np.where(np.asarray(score.is_null()), np.uint64(0), key)


def _pack_scores(group: list[str], rows: pa.Table) -> pa.RecordBatch:
    """Counts per distinct score, packed by (group, cell)."""
    code = np.zeros(rows.num_rows, np.int64)
    for c in group:
        coded = rows[c].combine_chunks().dictionary_encode("encode")
        code = code * max(len(coded.dictionary), 1) + np.asarray(coded.indices)
    key, pos = _ordered(rows["_score"]), np.asarray(rows["_pos"])
    neg = np.asarray(rows["_neg"])
    order = np.lexsort((key, code))
    code, key, pos, neg = code[order], key[order], pos[order], neg[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (key[1:] != key[:-1])]))
    first, code, key = order[new], code[new], key[new]
    pos, neg = np.add.reduceat(pos, new), np.add.reduceat(neg, new)
    cell = (key >> np.uint64(CELL_SHIFT)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])]))
    packs = [np.concatenate([key[a:b].view(np.int64), neg[a:b], pos[a:b]]).tobytes() for a, b in zip(at, np.append(at[1:], len(key)))]
    held = rows.select(group).take(pa.array(first[at])).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [*(held[c].combine_chunks() for c in group), pa.array(cell[at]), pa.array([pa.compress(p, "zstd", asbytes=True) for p in packs], pa.binary()),
         pa.array([len(p) for p in packs], pa.int64())], names=[*group, "_cell", "_pack", "_bytes"])


def _pairs_of(group: list[str]):
    """Counts of one (group, cell), and twice the pairs that its positives win against its own negatives."""
    def run(rows: pa.Table) -> pa.Table:
        raw = (np.frombuffer(pa.decompress(p, n, "zstd", asbytes=True), np.int64).reshape(3, -1) for p, n in zip(rows["_pack"].to_pylist(), rows["_bytes"].to_pylist()))
        key, neg, pos = np.concatenate(list(raw), 1)
        order = np.argsort(key.view(np.uint64), kind="stable")
        key, neg, pos = key[order], neg[order], pos[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        neg, pos = np.add.reduceat(neg, at), np.add.reduceat(pos, at)
        beaten = 2 * (np.cumsum(neg) - neg) + neg
        wins = (int((pos * (beaten >> 31)).sum()) << 31) + int((pos * (beaten & (2**31 - 1))).sum())  # may pass 64 bits
        return pa.table({**{c: rows[c].slice(0, 1) for c in [*group, "_cell"]}, "_neg": [int(neg.sum())], "_pos": [int(pos.sum())],
                         "_wins": pa.array([Decimal(wins)], pa.decimal128(38, 0))})

    return run


def roc_auc(df: DataFrame, group: list[str], y: str = "y_true", score: str = "p_up",
            tie: str = "sample_id") -> DataFrame:
    """Mann-Whitney form from the counts per distinct score; null for one class.

    A positive beats the negatives with a lower score and half of those with its own. Tasks pack the counts of
    their rows by group and cell of scores, so rows move once, as bytes, and none is written; pairs inside a
    cell are counted where its packets meet, pairs across cells from a few thousand sums per group. ``tie`` is
    not needed any more and is kept for callers.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)
    named = [f"`{c}` {kind[c]}" for c in group]
    slim = df.select(*group, F.col(score).cast("double").alias("_score"), F.coalesce(F.col(y).cast("long"), F.lit(0)).alias("_pos"),
                     F.coalesce(1 - F.col(y).cast("long"), F.lit(0)).alias("_neg"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK_ROWS:
                yield _pack_scores(group, pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield _pack_scores(group, pa.Table.from_batches(held))

    packs = slim.mapInArrow(pack, ", ".join([*named, "_cell long, _pack binary, _bytes long"]))
    cells = packs.groupBy(*group, "_cell").applyInArrow(_pairs_of(group), ", ".join([*named, "_cell long, _neg long, _pos long, _wins decimal(38,0)"]))
    below = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    g = cells.groupBy(*group).agg(
        F.sum("_neg").alias("_n"), F.sum("_pos").alias("_p"),
        F.sum(F.col("_wins") + F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below")).cast("decimal(19,0)")).alias("_w"))
    return g.select(*group, ratio(F.col("_w").cast("double") / 2, F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"))


def confidence_rank(df: DataFrame, group: list[str], tie: str = "sample_id", keep_tie: bool = True) -> DataFrame:
    """Most confident first, ties by ``tie`` ascending; without ``keep_tie`` the ranking is written without it."""
    return group_rank(df, group, [F.col("confidence").desc(), F.col(tie).asc()], () if keep_tie else (tie,))


def prefix_sums(ranked: DataFrame, group: list[str], values: dict[str, Column],
                block: int = 65536) -> DataFrame:
    """Running sums along ``rk``: blocks of equal rank width, then the few block totals."""
    blocked = ranked.withColumn("_b", F.floor((F.col("rk") - 1) / F.lit(block)).cast("long"))
    inner = Window.partitionBy(*group, "_b").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy(*group, "_b").agg(*[F.sum(v).alias("_t_" + k) for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_b", *[
        F.coalesce(F.sum("_t_" + k).over(before), F.lit(0)).alias("_t_" + k) for k in values])
    out = join_on_groups(blocked.withColumns({k: F.sum(v).over(inner) for k, v in values.items()}), totals, group + ["_b"])
    return out.withColumns({k: F.col(k) + F.col("_t_" + k) for k in values}).drop(
        "_b", *["_t_" + k for k in values])


def selective_summary(ranked: DataFrame, group: list[str], onset: float | None = None) -> DataFrame:
    """AURC, oracle AURC, excess, AUGRC and full risk from the ranks of the errors alone.

    The mean over k of errors_k / k is sum over errors at rank j of (H_n - H_{j-1}) / n, so no
    running sum over rows is needed: one pass of partial aggregates.
    """
    n, j = F.col("group_n"), F.col("rk")
    wrong = 1 - F.col("correct")
    terms = [F.sum(wrong).alias("_e"), F.max("group_n").alias("n_rows"),
             F.sum(F.when(wrong == 1, harmonic(n) - harmonic(j - 1)).otherwise(0.0)).alias("_a"),
             F.sum(wrong * (n - j + 1)).alias("_g")]
    if onset is not None:
        first = F.greatest(F.ceil(F.round(F.lit(onset) * n, 9)), F.lit(1)).cast("long")
        terms.append(F.sum(F.when(wrong == 1, harmonic(n) - harmonic(F.greatest(j, first) - 1))
                           .otherwise(0.0)).alias("_pa"))
    g = ranked.groupBy(*group).agg(*terms)
    n, e = F.col("n_rows"), F.col("_e")
    good = n - e
    oracle = (e - good * (harmonic(n) - harmonic(good))) / n
    out = {"aurc": F.col("_a") / n, "oracle_aurc": oracle, "e_aurc": F.col("_a") / n - oracle,
           "augrc": F.col("_g") / n / n, "full_coverage_risk": ratio(e, n)}
    if onset is not None:
        first = F.greatest(F.ceil(F.round(F.lit(onset) * n, 9)), F.lit(1)).cast("long")
        out["partial_aurc"] = F.col("_pa") / (n - first + 1)
    return g.select(*group, "n_rows", *[v.alias(k) for k, v in out.items()])


def exact_quantiles(ranked: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles read off the ranks: (group, q, quantile).

    Each group asks for the two ranks around every quantile; an equi-join on the rank fetches
    just those rows, so nothing holds all values.
    """
    sizes = ranked.groupBy(*group).agg(F.max("group_n").alias("_n"))
    want = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    h = F.col("q") * (F.col("_n") - 1)
    want = want.withColumn("_w", h - F.floor(h)).withColumn(
        "_e", F.explode(F.array(F.struct(F.lit(True).alias("lo"), (F.floor(h) + 1).alias("rk")),
                                F.struct(F.lit(False).alias("lo"), (F.ceil(h) + 1).alias("rk")))))
    want = want.select(*group, "q", "_w", "_e.lo", F.col("_e.rk").alias("rk"))
    want = materialise(want, "quantile-ranks")
    g = join_on_groups(ranked.select(*group, "rk", value), want, group + ["rk"]).groupBy(*group, "q").agg(
        F.max(F.when(F.col("lo"), F.col(value))).alias("_l"), F.max(F.when(~F.col("lo"), F.col(value))).alias("_h"),
        F.max("_w").alias("_w"))
    return g.select(*group, "q", (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_w")).alias("quantile"))
