"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenized and cut into pieces. Full pieces are sequences of their own; the shorter ones
are dealt into blocks of bounded size. On each block some islands evolve a population of packings:
crossover injects whole well-filled sequences of one parent into the other, drops the sequences that
now hold a piece twice, and best-fits the displaced pieces. Between epochs the best packing of each
island migrates to the next island of its block. The least filled sequences of all blocks are
dissolved and dealt into new blocks for a second pass, so that blocks do not each keep a loose end.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise, small_batches
from .chunks import HELD, ChunkTable, cut_at_space_before_word, forget_tables, give_back, slabs, utf8
from .common import documents

CAPACITY = 1024
END_ID = 2
PROBES = ["", " the 12,345 things'll  do\n\n", "Straße été niño 漢字 😀\t!!", " a\u00a0b \u2003c"]
BLOCK = 16384  # pieces in a block
ISLANDS = 2
POPULATION = 3
EPOCHS = 2
GENERATIONS = 3  # without a gain
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
GENOME = "block long, island int, pieces binary, sizes binary, bins binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def token_table(path: str) -> ChunkTable:
    """Chunk table of a tokenizer file. Where the same vocabulary is beside it as ranks, the faster library segments."""
    from tokenizers import Tokenizer

    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
    special = [t.content.encode() for t in whole().get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if os.path.exists(ranks):
        import tiktoken
        from public_tokenizers import PATTERN

        probed = [whole().encode(t, add_special_tokens=False).ids for t in PROBES]
        whole.cache_clear()  # only texts that hold a special token need it again
        give_back()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        if [fast.encode_ordinary(t) for t in PROBES] != probed:
            fast = None
        del table
        give_back()

    def encode(chunks: list[bytes]) -> list[list[int]]:
        if fast is None or any(s in c for s in special for c in chunks):
            return [e.ids for e in whole().encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        return [fast.encode_ordinary(c.decode()) for c in chunks]

    return ChunkTable(encode)


HELD["tokens"] = token_table.cache_clear


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_tables("tokens")
        uid = TaskContext.get().partitionId() << 40
        table = token_table(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in slabs(texts, 3 << 20):
                data, starts = utf8(texts.slice(a, b - a))
                rows, place, before = table.cut(data, starts, cut_at_space_before_word)
                ids, at = table.join(rows[place], before)
                out: list[list] = [[], [], [], [], []]
                for i in range(b - a):
                    own = np.append(ids[at[i]:at[i + 1]], end_id).astype("<u4")
                    first = (len(own) - 1) % capacity + 1  # the first piece takes what full pieces leave
                    lo, piece = 0, 0
                    while lo < len(own):
                        hi = first if lo == 0 else lo + capacity
                        for into, x in zip(out, (a + i, piece, lo, hi - lo, zlib.crc32(own[lo:hi].tobytes()))):
                            into.append(x)
                        lo, piece = hi, piece + 1
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:]),
                     pa.array(np.arange(uid, uid + n))], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
                uid += n
            give_back()

    return run


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document; ``uid`` numbers them and is fixed once the table is written."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end_id), PIECES)


class Bins:
    """Open sequences by free space; a bit mask finds the tightest fit in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.items: list[list[int]] = []

    def add(self, items: list[int], used: int) -> None:
        space = self.capacity - used
        self.by_space[space].append(len(self.items))
        self.mask |= 1 << space
        self.items.append(items)

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add([item], size)
            return
        space = size + (fits & -fits).bit_length() - 1
        at = self.by_space[space].pop()
        if not self.by_space[space]:
            self.mask &= ~(1 << space)
        self.items[at].append(item)
        left = space - size
        self.by_space[left].append(at)
        self.mask |= 1 << left


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones: few loose ends are worth more than many small gaps."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def fresh(size: list[int], capacity: int, rng: np.random.Generator, blur: float) -> list[list[int]]:
    """Best fit in falling order of a blurred size."""
    s = np.asarray(size, float)
    order = np.argsort(-s * (1 + blur * rng.standard_normal(len(s))), kind="stable").tolist()
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, size[i])
    return bins.items


def crossover(giver: list[list[int]], taker: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled sequences of ``giver`` into ``taker`` and best-fit what they displace."""
    full = [b for b in giver if sum(size[i] for i in b) >= capacity - 1]
    if not full:
        full = sorted(giver, key=lambda b: -sum(size[i] for i in b))[:max(1, len(giver) // 4)]
    chosen = [full[k] for k in np.flatnonzero(rng.random(len(full)) < 0.6)] or full[:1]
    held = {i for b in chosen for i in b}
    bins, loose = Bins(capacity), []
    for b in chosen:
        bins.add(list(b), sum(size[i] for i in b))
    for b in taker:
        used = sum(size[i] for i in b)
        if held.isdisjoint(b) and (used >= capacity - 8 or rng.random() < 0.5):  # some slack ones are dissolved as mutation
            bins.add(list(b), used)
        else:
            loose += [i for i in b if i not in held]
    loose.sort(key=lambda i: -size[i])
    for i in loose:
        bins.best_fit(i, size[i])
    return bins.items


def evolve(population: list[list[list[int]]], size: list[int], capacity: int, rng: np.random.Generator, generations: int) -> list[list[list[int]]]:
    """Until the fewest sequences that can be, or ``generations`` of them on end without one sequence fewer."""
    least = -(-sum(size) // capacity)
    scored = sorted(((fitness(p, size, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    idle = 0
    while idle < generations and -scored[0][0][0] > least:
        fewest = scored[0][0][0]
        giver, taker = scored[0][1], scored[1 + int(rng.integers(len(scored) - 1))][1]
        if rng.random() < 0.5:
            giver, taker = taker, giver
        child = crossover(giver, taker, size, capacity, rng)
        scored = sorted([*scored, (fitness(child, size, capacity), child)], key=lambda x: x[0], reverse=True)[:len(population)]
        idle = 0 if scored[0][0][0] > fewest else idle + 1
    return [p for _, p in scored]


def _encode_bins(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _decode_bins(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _rng(block: int, island: int, epoch: int) -> np.random.Generator:
    return np.random.default_rng([block & 0xFFFFFFFF, island, epoch])


def _genome(block: int, island: int, pieces: np.ndarray, size: np.ndarray, bins: list[list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"block": [block], "island": [island], "pieces": [pieces.tobytes()], "sizes": [size.tobytes()], "bins": [_encode_bins(bins, len(size))]})


def _settle(capacity: int, generations: int):
    """First epoch: an island's population from scratch."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rows = rows.sort_values("uid")
        pieces, size = rows["uid"].to_numpy(np.int64), rows["length"].to_numpy(np.int64)
        rng, listed = _rng(block, island, 0), size.tolist()
        population = [fresh(listed, capacity, rng, 0.0 if i == island == 0 else 0.02 * (i + island)) for i in range(POPULATION)]
        return _genome(block, island, pieces, size, evolve(population, listed, capacity, rng, generations)[0])

    return run


def _epoch(capacity: int, generations: int, epoch: int):
    """A later epoch: the island's own elite meets those that migrated here."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rows = rows.sort_values("island", kind="stable")
        pieces, size = np.frombuffer(rows["pieces"].iloc[0], np.int64), np.frombuffer(rows["sizes"].iloc[0], np.int64)
        rng, listed = _rng(block, island, epoch), size.tolist()
        population = [_decode_bins(b) for b in rows["bins"]]
        population += [fresh(listed, capacity, rng, 0.03) for _ in range(max(0, POPULATION - len(population)))]
        return _genome(block, island, pieces, size, evolve(population, listed, capacity, rng, generations)[0])

    return run


def _best(capacity: int, keep_above: int):
    """The best island of a block as rows; sequences filled below ``keep_above`` are marked open."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        size = np.frombuffer(rows["sizes"].iloc[0], np.int64)
        pieces = np.frombuffer(rows["pieces"].iloc[0], np.int64)
        listed = size.tolist()
        best = max((_decode_bins(b) for b in rows.sort_values("island")["bins"]), key=lambda b: fitness(b, listed, capacity))
        out = []
        for k, b in enumerate(best):
            used = 0
            closed = int(size[b].sum()) >= keep_above
            for i in b:
                out.append((int(pieces[i]), int(key[0]), k, used, int(size[i]), closed))
                used += listed[i]
        return pd.DataFrame(out, columns=["uid", "block", "bin", "offset", "length", "closed"])

    return run


PLACED = "uid long, block long, bin int, offset long, length long, closed boolean"


def islands(short: DataFrame, blocks: int, seed: int, capacity: int, keep_above: int) -> DataFrame:
    """Places pieces (uid, length), dealt over ``blocks`` blocks by a hash of uid."""
    dealt = short.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)).alias("block"))
    own = dealt.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    genomes = own.groupBy("block", "island").applyInPandas(_settle(capacity, GENERATIONS), GENOME)
    for epoch in range(1, EPOCHS):
        genomes = materialise(genomes, "islands")
        moved = genomes.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        genomes = genomes.unionByName(moved).groupBy("block", "island").applyInPandas(_epoch(capacity, GENERATIONS, epoch), GENOME)
    return genomes.groupBy("block").applyInPandas(_best(capacity, keep_above), PLACED)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts are one piece that holds the end id. Repeated rows are packed as rows of their
    own. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = materialise(cut(docs, tokenizer, capacity, end_id), "pieces")
    whole = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity)
    count = short.count()
    first = materialise(islands(short, max(1, -(-count // block)), 0, capacity, int(capacity * 0.995)), "packed")
    closed = first.filter("closed")
    loose = first.filter("NOT closed").select("uid", "length")
    again = max(1, -(-loose.count() // block))
    second = islands(loose, again, 1, capacity, 0).withColumn("block", -F.col("block") - 1)
    # A sequence is named by one of its pieces: names are unique and below those of no other.
    placed = closed.unionByName(second)
    head = F.min("uid").over(_of_bin())
    placed = placed.select("uid", "offset", head.alias("sequence_id"))
    return short.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").unionByName(whole)


def _of_bin():
    from pyspark.sql import Window

    return Window.partitionBy("block", "bin")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
