"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables cuts ``hashes`` random projections into cells of one width; a bucket is a vector of
cells. A query visits its own bucket and those reached by steps to adjacent cells, in the order of the
estimated chance to hold a neighbour: the sum of squared distances from the query to the walls crossed.
Candidates of all tables are ranked by exact distance.

Cell width, number of hashes and number of probes are fitted on a bounded sample of queries, whose true
neighbours are found by brute force, so that ``RECALL`` of these are reached at the least estimated cost. A
query that meets too few candidates is compared with all rows. Every distinct vector is indexed once, with
its smallest ids; large buckets are split into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise, ship_package
from .chunks import give_back
from .common import table
from .shingles import mix

TABLES = 3
RECALL = 0.96  # of the fitting sample
FIT_QUERIES = 128
FIT_ROWS = 8192  # rows of the sample that tells bucket sizes and first thresholds
HASHES = (1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24)
WIDTHS = (0.75, 1.5, 3.0)  # cell width over the median distance of a k-th neighbour
PROBES = 1024  # most probes of a table that are considered
PROBE_COST = 48  # distances that cost as much as one more probe
DATA_BLOCK, QUERY_BLOCK = 4096, 1024
REST_BLOCK = 2048
PART_BYTES = 48 << 20
SEED = 20261128


def packed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.dtype, int]:
    """(vec_id, v): each usable vector as its bytes; then the number type and the length.

    Left out are rows without id, and vectors that are null, zero, hold a null or non-finite component, or
    differ in length from the most frequent length (of equally frequent ones the smaller).
    """
    sizes = vectors.filter(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(F.size(column).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    most = sizes.orderBy(F.desc("c"), "n").first()
    dim = most["n"] if most else 0
    kind = np.dtype("<f4") if vectors.schema[column].dataType.elementType.simpleString() == "float" else np.dtype("<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            keep = pc.and_(pc.is_valid(batch.column(key)), pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            batch = batch.filter(keep)
            x = batch.column(column).flatten().cast(pa.float32() if kind.itemsize == 4 else pa.float64())
            x = np.asarray(pc.fill_null(x, float("nan"))).astype(kind).reshape(-1, dim)
            some = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(some)), _binary(x[some])], names=["vec_id", "v"])

    rows = vectors.select(key, column)
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, v binary"
    return (rows if dim else rows.limit(0)).mapInArrow(run if dim else _nothing, schema), kind, dim


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    return iter(())


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(col: pa.Array, kind: np.dtype, dim: int) -> np.ndarray:
    arr = col.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return raw.view(kind).reshape(-1, dim).astype(np.float64)


def templates(hashes: int, n: int) -> np.ndarray:
    """The first ``n`` sets of steps by expected score, as a 0/1 matrix over the 2 * hashes steps sorted by wall distance.

    Steps j and 2 * hashes - 1 - j cross opposite walls of one cell and never occur together.
    """
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < n:
        score, steps = heapq.heappop(heap)
        if all(2 * m - 1 - s not in steps for s in steps):
            out.append(steps)
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + cost[last + 1], (*steps, last + 1)))
            heapq.heappush(heap, (score + cost[last + 1] - cost[last], (*steps[:-1], last + 1)))
    flags = np.zeros((len(out), 2 * m))
    for i, steps in enumerate(out):
        flags[i, list(steps)] = 1
    return flags


class Hashing:
    """Projections, cells and probing sequences of all tables. ``width`` is the cell width."""

    def __init__(self, dim: int, hashes: int, width: float, probes: int = 1):
        rng = np.random.default_rng(SEED)
        self.hashes, self.width, self.probes = hashes, width, probes
        self.lines = rng.standard_normal((TABLES, max(HASHES), dim))[:, :hashes]
        self.shift = rng.random((TABLES, max(HASHES)))[:, :hashes] * width
        self.odd = rng.integers(1, 2**63, max(HASHES), np.uint64)[:hashes] | np.uint64(1)
        self.flags = templates(hashes, min(4 * probes, 3 ** hashes)) if probes > 1 else np.zeros((1, 2 * hashes))

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """Positions on the lines of table ``t``, in cell widths."""
        return (x @ self.lines[t].T + self.shift[t]) / self.width

    def names(self, cells: np.ndarray, t: int) -> np.ndarray:
        """Bucket names of cells (their last axis)."""
        h = (cells.astype(np.int64).astype(np.uint64) * self.odd).sum(-1, dtype=np.uint64)
        return mix(h + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)

    def probing(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the buckets each row of ``x`` visits in order, and their scores."""
        at = self.places(x, t)
        cell = np.floor(at)
        down = at - cell
        walls = np.concatenate([down, 1 - down], 1) ** 2
        order = np.argsort(walls, 1, kind="stable")
        score = np.take_along_axis(walls, order, 1) @ self.flags.T
        best = np.argsort(score, 1, kind="stable")[:, :self.probes]
        names = np.empty(best.shape, np.int64)
        m = self.hashes
        for a in range(0, len(x), 64):
            steps = np.zeros((len(x[a:a + 64]), best.shape[1], 2 * m))
            np.put_along_axis(steps, np.broadcast_to(order[a:a + 64, None, :], steps.shape), self.flags[best[a:a + 64]], 2)
            names[a:a + 64] = self.names(cell[a:a + 64, None, :] - steps[:, :, :m] + steps[:, :, m:], t)
        return names, np.take_along_axis(score, best, 1)


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0)


def _close(q: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact distance) of each query's ``k`` nearest rows and their ties within its limit."""
    square = _squares(q, x)
    slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max(initial=0))
    reach = limit ** 2
    if square.shape[1] > k:
        reach = np.minimum(reach, np.partition(square, k - 1, 1)[:, k - 1])
    i, j = np.nonzero(square <= (reach + 2 * slack)[:, None])
    return i, j, np.sqrt(((q[i] - x[j]) ** 2).sum(1))


def _expand(ids: pa.Array, i: np.ndarray, j: np.ndarray, d: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """A row for each id of each found vector."""
    at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))])
    size = at[j + 1] - at[j]
    ends = np.cumsum(size)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[j] - (ends - size), size)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(own[i], size), pa.int64()), ids.flatten().take(pa.array(take)), pa.array(np.repeat(d, size))], names=["q", "vec_id", "d"])


def _scan(asked, k: int, kind: np.dtype, dim: int):
    """The nearest rows of a task for a block of queries (q, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = asked.value
        limit = np.full(len(q), np.inf)
        for batch in batches:
            for a in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(a, DATA_BLOCK)
                x = _matrix(part.column("v"), kind, dim)
                for b in range(0, len(q), 256):
                    i, j, d = _close(q[b:b + 256], x, k, limit[b:b + 256])
                    yield _expand(part.column("ids"), i + b, j, d, names)
                    if len(x) >= k:  # k rows are k ids at least
                        limit[b:b + 256] = np.minimum(limit[b:b + 256], np.sqrt(np.partition(_squares(q[b:b + 256], x), k - 1, 1)[:, k - 1]) * (1 + 1e-9) + 1e-9)
        give_back()

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, d): the k nearest distinct ids of each query."""
    order = Window.partitionBy("q").orderBy("d", "vec_id")
    once = found.groupBy("q", "vec_id").agg(F.min("d").alias("d"))
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def fit(classes: DataFrame, asked: DataFrame, rows: int, k: int, kind: np.dtype, dim: int) -> tuple[Hashing, np.ndarray, float]:
    """Hashing for these rows, the sample of rows, and the recall reached on the fitting sample."""
    context = classes.sparkSession.sparkContext
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).toArrow()
    near = _matrix(sample["v"].combine_chunks(), kind, dim)
    some = asked.orderBy(F.xxhash64("v"), "v").limit(FIT_QUERIES).toArrow()
    q = _matrix(some["v"].combine_chunks(), kind, dim)
    names = np.arange(len(q), dtype=np.int64)
    # The class of a query is its own nearest row, so one more is asked for and distance 0 does not count.
    truth = classes.mapInArrow(_scan_rows(context.broadcast((names, q)), k + 1, kind, dim), "q long, v binary, d double")
    order = Window.partitionBy("q").orderBy("d", "v")
    truth = truth.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= k + 1) & (F.col("d") > 0)).toArrow()
    of, x, d = np.asarray(truth["q"]), _matrix(truth["v"].combine_chunks(), kind, dim), np.asarray(truth["d"])
    if not len(of):
        return Hashing(dim, 1, float(np.abs(near).max(initial=1.0)) or 1.0, 3), near, 1.0
    farthest = np.zeros(len(q))
    np.maximum.at(farthest, of, d)
    usual = float(np.median(farthest[farthest > 0]))
    best = None
    for hashes in HASHES:
        for factor in WIDTHS:
            trial = Hashing(dim, hashes, usual * factor, PROBES)
            rank, visited = np.full(len(of), np.iinfo(np.int64).max), []
            for t in range(TABLES):
                buckets, _ = trial.probing(q, t)
                target = trial.names(np.floor(trial.places(x, t)), t)
                hit = buckets[of] == target[:, None]
                rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1) + 1, np.iinfo(np.int64).max))
                name, size = np.unique(trial.names(np.floor(trial.places(near, t)), t), return_counts=True)
                at = np.minimum(np.searchsorted(name, buckets), len(name) - 1)
                visited.append(np.cumsum(np.where(name[at] == buckets, size[at], 0).mean(0)))
            ranked = np.sort(rank)
            probes = ranked[min(int(np.ceil(RECALL * len(ranked))), len(ranked)) - 1]
            reached = float((rank <= min(probes, PROBES)).mean())
            probes = int(min(probes, trial.flags.shape[0], PROBES))
            met = sum(v[min(probes, len(v)) - 1] for v in visited) * rows / len(near)
            cost = (reached < RECALL, met + TABLES * probes * PROBE_COST if reached >= RECALL else -reached)
            if best is None or cost < best[0]:
                best = cost, hashes, usual * factor, probes, reached
    _, hashes, width, probes, reached = best
    return Hashing(dim, hashes, width, probes), near, reached


def _scan_rows(asked, k: int, kind: np.dtype, dim: int):
    """As ``_scan``, with the vectors found instead of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = asked.value
        for batch in batches:
            for a in range(0, batch.num_rows, DATA_BLOCK):
                col = batch.column("v").slice(a, DATA_BLOCK)
                i, j, d = _close(q, _matrix(col, kind, dim), k, np.full(len(q), np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), col.take(pa.array(j)), pa.array(d)], names=["q", "v", "d"])

    return run


def _indexed(hashing, kind: np.dtype, dim: int, names_only: bool):
    """Each distinct vector in its bucket of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing.value
        for batch in batches:
            for a in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(a, DATA_BLOCK)
                x = _matrix(part.column("v"), kind, dim)
                for t in range(TABLES):
                    bucket = pa.array(h.names(np.floor(h.places(x, t)), t))
                    yield pa.RecordBatch.from_arrays([bucket] if names_only else [bucket, part.column("v"), part.column("ids")], names=["bucket"] if names_only else ["bucket", "v", "ids"])

    return run


def _probing(hashing, near, kind: np.dtype, dim: int, k: int, names_only: bool):
    """Each distinct query in every bucket it visits, with a distance within which ``k`` other rows are known to lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, known = hashing.value, near.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = _matrix(part.column("v"), kind, dim)
                limit = np.full(len(x), np.inf)
                if len(known) > k + 1 and not names_only:
                    limit = np.sqrt(np.partition(_squares(x, known), k + 1, 1)[:, k + 1]) * (1 + 1e-9) + 1e-9
                for t in range(TABLES):
                    names, _ = h.probing(x, t)
                    row = pa.array(np.repeat(np.arange(len(x)), names.shape[1]))
                    cols = [pa.array(names.reshape(-1))]
                    if not names_only:
                        cols += [part.column("v").take(row), part.column("q").take(row), pa.array(limit).take(row)]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "v", "q", "within"][:len(cols)])

    return run


def _solve(k: int, kind: np.dtype, dim: int):
    """Streams rows sorted by block, queries first, and compares the queries of a block with its rows."""

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        n = pc.sum(pc.is_valid(rows["q"])).as_py() or 0
        if not n or n == rows.num_rows:
            return None
        rows = rows.combine_chunks()
        v, ids = rows["v"].chunk(0), rows["ids"].chunk(0).slice(n)
        q, x = _matrix(v.slice(0, n), kind, dim), _matrix(v.slice(n), kind, dim)
        own, within = np.asarray(rows["q"].chunk(0).slice(0, n)), np.asarray(rows["within"].chunk(0).slice(0, n))
        found = [_close(q[a:a + 256], x, k, within[a:a + 256]) for a in range(0, n, 256)]
        i = np.concatenate([f[0] + 256 * b for b, f in enumerate(found)])
        return _expand(ids, i, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("bucket", "qb", "db")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == b:
                    continue
                here = tuple(key[a])
                if held and here != last:
                    out = block(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = here
        if held:
            out = block(pa.Table.from_batches(held))
            if out is not None:
                yield out
        give_back()

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query by Euclidean distance, its own id left out.

    Both frames have vec_id and embedding (see ``packed`` for rows that take no part; other columns are not
    read). Ties go to the smaller vec_id. Rows that repeat an id with the same vector count once; an id with
    several vectors is as near as its nearest. With k candidates or fewer all are returned; without
    candidates or queries, no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    context = spark.sparkContext
    rows, kind, dim = packed(vectors)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {queries.schema['vec_id'].dataType.simpleString()}, rank int, vec_id {id_type}, score double")
    if not dim:
        return empty
    few = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.distinct().withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1)
    classes = materialise(classes.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-rows")
    wanted, _, q_dim = packed(queries)
    wanted = materialise(wanted.distinct(), "ann-queries")
    n_rows = classes.count()
    if q_dim != dim or not n_rows or wanted.isEmpty():
        return empty
    asked = materialise(wanted.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-asked")  # written, so that a number stays with its row
    hashing, near, _ = fit(classes, asked, n_rows, k, kind, dim)
    shared, known = context.broadcast(hashing), context.broadcast(near)

    stored = classes.mapInArrow(_indexed(shared, kind, dim, True), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    visits = asked.mapInArrow(_probing(shared, known, kind, dim, k, True), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_visits"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    large = materialise(stored.join(visits, "bucket").filter((F.col("n_rows") > DATA_BLOCK) | (F.col("n_visits") > QUERY_BLOCK))
                        .select("bucket", blocks("n_rows", DATA_BLOCK).alias("dbs"), blocks("n_visits", QUERY_BLOCK).alias("qbs")), "ann-large")
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    data = classes.mapInArrow(_indexed(shared, kind, dim, False), f"bucket long, v binary, ids array<{id_type}>").join(large, "bucket", "left")
    data = data.withColumn("db", F.pmod(F.xxhash64("v"), one(F.col("dbs"))).cast("int")).withColumn("qb", every("qbs"))
    data = data.select("bucket", "qb", "db", "v", F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("within"), "ids")
    probes = asked.mapInArrow(_probing(shared, known, kind, dim, k, False), "bucket long, v binary, q long, within double").join(large, "bucket", "left")
    probes = probes.withColumn("qb", F.pmod(F.xxhash64("q"), one(F.col("qbs"))).cast("int")).withColumn("db", every("dbs"))
    probes = probes.select("bucket", "qb", "db", "v", "q", "within", F.lit(None).cast(f"array<{id_type}>").alias("ids"))
    volume = (n_rows * TABLES + asked.count() * TABLES * hashing.probes) * (dim * kind.itemsize + 64)
    parts = max(2 * context.defaultParallelism, volume // PART_BYTES + 1)
    met = data.unionByName(probes).repartition(parts, "bucket", "qb", "db").sortWithinPartitions("bucket", "qb", "db", F.col("q").isNull())
    found = f"q long, vec_id {id_type}, d double"
    best = materialise(_nearest(met.mapInArrow(_solve(k + 1, kind, dim), found), k + 1), "ann-found")

    rest = materialise(asked.join(best.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k), "q", "left_anti"), "ann-rest")
    n_blocks = -(-rest.count() // REST_BLOCK)
    for b in range(n_blocks):
        part = rest.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).toArrow()
        if part.num_rows:
            block = context.broadcast((np.asarray(part["q"]), _matrix(part["v"].combine_chunks(), kind, dim)))
            best = best.unionByName(_nearest(classes.mapInArrow(_scan(block, k + 1, kind, dim), found), k + 1))
    lists = _nearest(best, k + 1)
    ids = wanted.withColumnRenamed("vec_id", "query_id").join(asked, "v").select("q", "query_id")
    pairs = lists.join(ids, "q").filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("d").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
