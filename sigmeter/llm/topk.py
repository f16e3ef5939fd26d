"""Exact top-k by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivot. Each data group is summarised by its k + 1 members
nearest to the pivot; from these and a query group's centre and radius follows a score that every query
of the group is sure to reach k times. A data row is sent to a query group only if its best possible
score there reaches that bound. Groups are solved in blocks: (query block, data block) pairs give partial
lists, and lists meet per query. Copies of a vector beyond the k + 1 smallest ids can enter no list and are
set aside before. Vectors travel as bytes of 64-bit integers in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise, ship_package
from .chunks import give_back
from .common import table

PIVOTS = 32  # bounds what reaches the driver: PIVOTS * (k + 1) vectors
QUERY_BLOCK = 1024
DATA_BLOCK = 8192
QUERY_STEP = 64  # queries scored against a data block at once
EXACT_FLOAT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component as long; rows that are null or hold a null or non-finite component are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id and v as bytes, one row per id: of the vectors of an id the first in byte order stays.

    Left out are rows without id or vector and those that differ in length from the most frequent length (of equally
    frequent ones the smaller).
    """
    rows = vectors.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    dim = most["n"] if most else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), dim))
            x = np.asarray(batch.column("v").flatten().cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _bytes(x.reshape(-1, dim))], names=["vec_id", "v"])
        give_back()

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def _bytes(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * 8
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = col.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return raw.view(np.int64).reshape(len(arr), -1) if len(arr) else np.zeros((0, 1), np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. Floats are exact up to 2**53; beyond, 64-bit integers are used."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < EXACT_FLOAT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top >= 2.0 ** 63:
        raise OverflowError("inner products do not fit 64 bits")
    return q @ x.T


def _grouped(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.astype(float)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v")).astype(float)
                d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(x)), cell]))], names=["vec_id", "v", "cell", "far"])
        give_back()

    return run


class Bounds:
    """For each query group a score that each of its queries reaches k times without itself."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, members: np.ndarray, k: int):
        self.pivots, self.radius = pivots.astype(float), radius
        norm = np.linalg.norm(members.astype(float), axis=1)
        low = self.pivots @ members.astype(float).T - radius[:, None] * norm[None, :]
        low.sort(axis=1)
        # the query itself may be among the members, so one more is asked for
        self.floor = low[:, -(k + 1)] if members.shape[0] > k else np.full(len(pivots), -np.inf)

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """rows x groups: whether a row may enter a list of the group. Rounding is on the side of sending."""
        x = x.astype(float)
        high = x @ self.pivots.T + np.linalg.norm(x, axis=1)[:, None] * self.radius[None, :]
        slack = 1e-6 * (1 + np.abs(self.floor, where=np.isfinite(self.floor), out=np.zeros(len(self.floor))))
        return (high >= self.floor - slack) & (self.radius >= 0)


def _replicated(bounds: Bounds, query_blocks: np.ndarray):
    """Each row once for every query block of every group whose lists it may enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                r, g = np.nonzero(bounds.wanted(_matrix(part.column("v"))))
                n = query_blocks[g]
                ends = np.cumsum(n)
                block = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
                take = pa.array(np.repeat(r, n))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(take), part.column("v").take(take), pa.array(np.repeat(g, n).astype(np.int32)), pa.array(block.astype(np.int32))],
                                                 names=["vec_id", "v", "grp", "qb"])
        give_back()

    return run


def best_of(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows but its own; ``ids`` rise, so of equal scores the smaller ids stay."""
    out = []
    for a in range(0, len(queries), QUERY_STEP):
        s = scores(queries[a:a + QUERY_STEP], x)
        mine = own[a:a + QUERY_STEP]
        at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
        hit = ids[at] == mine
        s[np.flatnonzero(hit), at[hit]] = np.iinfo(np.int64).min
        for i, row in enumerate(s):
            if len(row) > k:
                cut = np.partition(row, len(row) - k)[len(row) - k]
                over = np.flatnonzero(row > cut)
                pick = np.concatenate([over, np.flatnonzero(row == cut)[:k - len(over)]])
            else:
                pick = np.arange(len(row))
            pick = pick[ids[pick] != mine[i]]
            out.append((np.full(len(pick), mine[i]), ids[pick], row[pick]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _solve(k: int):
    """Streams rows sorted by block, queries first, and scores the queries of a block against its rows."""

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        n = pc.sum(pc.cast(rows["asks"], pa.int64())).as_py()
        if not n or n == rows.num_rows:
            return None
        ids = np.asarray(rows["vec_id"].combine_chunks())
        x = _matrix(rows["v"])
        order = np.argsort(ids[n:], kind="stable")
        q, i, s = best_of(x[:n], ids[:n], x[n:][order], ids[n:][order], k)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("grp", "qb", "db")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == b:
                    continue
                if held and tuple(key[a]) != last:
                    out = block(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                    give_back()
                held.append(batch.slice(a, b - a))
                last = tuple(key[a])
        out = block(pa.Table.from_batches(held)) if held else None
        if out is not None:
            yield out
        give_back()

    return run


def distinct_enough(data: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no list can hold another. Tasks keep k + 1 of each before they shuffle."""
    # Two levels, so that a vector that is everywhere meets in one task as few rows as there are slots.
    for slot in (F.pmod("vec_id", F.lit(64)), F.lit(0)):
        w = Window.partitionBy("v", "slot").orderBy("vec_id")
        data = data.withColumn("slot", slot).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("vec_id", "v")
    return data


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``data`` for each query, its own id left out.

    Both frames have vec_id long and v array<long>; see ``packed`` for repeated ids and vectors of another length. Ties
    go to the smaller vec_id. With k candidates or fewer all are returned; without queries or data, no rows.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    spark = data.sparkSession
    ship_package(spark)
    data, queries = materialise(packed(data), "topk-data"), materialise(packed(queries), "topk-queries")
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    if not some.num_rows or queries.isEmpty():
        return spark.createDataFrame([], schema)
    centre = np.unique(_matrix(some["v"]), axis=0)
    if centre.shape[1] * 8 != len(queries.first()["v"]):  # no query has the length of the data
        return spark.createDataFrame([], schema)
    celled = "vec_id long, v binary, cell int, far double"
    thin = materialise(distinct_enough(data, k).mapInArrow(_grouped(centre), celled), "topk-cells")
    asked = materialise(queries.mapInArrow(_grouped(centre), celled), "topk-asked")

    near = Window.partitionBy("cell", "slot").orderBy("far", "vec_id")
    inner = thin.withColumn("slot", F.pmod("vec_id", F.lit(64))).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    inner = inner.withColumn("slot", F.lit(0)).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    members = _matrix(inner.select("v").toArrow()["v"])  # at most pivots * (k + 1)
    told = asked.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    radius, size = np.full(len(centre), -1.0), np.zeros(len(centre), int)
    for r in told:
        radius[r["cell"]], size[r["cell"]] = r["far"] * (1 + 1e-9) + 1e-9, r["n"]
    bounds = Bounds(centre, radius, members, k)
    blocks = np.maximum(1, -(-size // QUERY_BLOCK))
    pairs = thin.select("vec_id", "v").mapInArrow(_replicated(bounds, blocks), "vec_id long, v binary, grp int, qb int")
    n_rows = thin.count()
    n_data = max(1, -(-n_rows // DATA_BLOCK))
    block_of = F.array(*(F.lit(int(b)) for b in blocks))
    q = asked.select("vec_id", "v", F.col("cell").alias("grp")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.element_at(block_of, F.col("grp") + 1)).cast("int"))
    q = q.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1)))).withColumn("asks", F.lit(True))
    d = pairs.withColumn("db", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_data)).cast("int")).withColumn("asks", F.lit(False))
    keys = ["grp", "qb", "db"]
    parts = max(4 * spark.sparkContext.defaultParallelism, int(blocks.sum()) * n_data // 4)
    met = q.unionByName(d).repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("asks"))
    lists = met.mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(data, data.filter("vec_id % 20 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)) FOR x IN embedding])
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, d.v)]) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
