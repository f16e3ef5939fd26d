"""Near-duplicate join: Jaccard of word 5-shingles at least 0.75, by PartEnum signatures.

Sets are banded by size so that partners lie in the same or the next band. Within the instance of
two neighbouring bands the symmetric difference of a pair is bounded, so the hashed feature domain is
cut into first-level parts of ``N2`` cells, and a part in which the pair differs in at most ``K2``
features must agree on some ``N2 - K2`` of its cells. The content of every such choice of cells is
one signature; similar pairs share one with certainty (see ``signatures``). Shingles that very many
documents share are left out of signatures wherever enough others remain.

Signatures are dealt to parts of equal volume, an instance after the other, so a pair, which meets in two
instances at most, comes out of the few parts of these and not of all.

A bucket of equal signatures is not expanded into pairs. Every member is tied to one hub (a star), the
member of smallest key, so that all buckets of a cluster prefer the same hubs; the ties are verified on
the full sets, and components are formed. Only pairs of a bucket of three sets or more that are still in
different components afterwards are looked at, inside the bucket's task (a bucket of two is its one tie),
and those that pass a size and parity-sketch bound
are verified too, so no link between different components is lost. The sketch grows with the set, as one
of fixed length would be full, and exclude nothing, for long texts.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, small_batches
from .chunks import forget_tables, give_back, small
from .common import documents, located
from .components import components
from .exact_dedup import LOCATOR, file_backed
from .shingles import mix, sets

K2, N2 = 1, 3  # differences allowed in a part, cells of a part
SKETCH_WORDS = 8  # 64-bit words of the parity sketch, at least
SIGNATURES_PER_PART = 1 << 21  # as estimated from set sizes
BROADCAST_BYTES = 48 << 20
SAMPLE = 16000  # documents in which frequent shingles are looked for, about
FREQUENT = 0.0003  # share of the sample from which a shingle is frequent
MOST_FREQUENT = 100_000


def band_bounds(top: int = 1 << 40) -> list[int]:
    """Least size of each band; a set's largest possible partner lies at most one band higher."""
    out = [1]
    while out[-1] < top:
        out.append(4 * out[-1] // 3 + 1)
    return out


BANDS = np.array(band_bounds(), np.int64)


def instances(size: int) -> list[int]:
    """The instances that a set of this size takes part in: its own band as upper band, and as lower band."""
    own = int(np.searchsorted(BANDS, size, "right")) - 1
    return [own, own + 1]


def parts_of(instance: int) -> tuple[int, int]:
    """First-level parts and the largest set size of an instance."""
    top = int(BANDS[instance + 1]) - 1
    return int(np.ceil(1.2 * (2 * top / 7) / (K2 + 1))) + 3, top


class Deal:
    """Parts of equal volume over the signatures of all instances, in the order of instances.

    ``sets`` is the number of sets in each band. An instance reaches over as many neighbouring parts as
    its volume asks for, and small instances share one.
    """

    def __init__(self, sets: dict[int, int], capacity: int = SIGNATURES_PER_PART):
        load = np.zeros(max(sets, default=0) + 2)
        for t in range(len(load)):
            held = sets.get(t, 0) + sets.get(t - 1, 0)
            load[t] = held * min(3 * parts_of(t)[0], 2 * int(BANDS[t]))
        self.load, self.before, self.capacity = load, np.cumsum(load) - load, capacity
        self.parts = int(load.sum() // capacity) + 1

    def part(self, instance: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """By instance and the high 32 bits of a signature."""
        at = self.before[instance] + (sig >> np.uint64(32)).astype(float) * (self.load[instance] / 2.0**32)
        return np.minimum(at / self.capacity, self.parts - 1).astype(np.uint64)


def deal(sized: DataFrame) -> Deal:
    """Parts for the sets of a table with ``n_shingles``: one count per band goes to the driver."""
    band = F.size(F.filter(F.array(*(F.lit(int(b)) for b in BANDS)), lambda b: b <= F.col("n_shingles"))) - 1
    return Deal({r["band"]: r["count"] for r in sized.filter("n_shingles > 0").groupBy(band.alias("band")).count().collect()})


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures of one set; ``frequent`` are shingles that many documents share, sorted."""
    return np.concatenate([sig for _, sig in by_instance(s, frequent)])


def by_instance(s: np.ndarray, frequent: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Signatures of one set with the instance they belong to.

    A pair that differs in at most d features differs in at most d of those left when the frequent ones are
    taken out, so signatures over the others alone are complete too, as long as enough cells hold one. A set
    for which they are not (``_over`` says so) emits signatures over all its features as well, so that
    two such sets still share one.
    """
    rare = s
    if len(frequent):
        rare = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
    out = []
    for t in instances(len(s)):
        first, safe = _over(rare, len(s), t, 0)
        out.append((t, first))
        if not safe:
            second, safe = _over(s, len(s), t, 1)
            out.append((t, second))
            if not safe:
                out.append((t, _over(s, len(s), t, 1, True)[0]))
    return out


def _over(s: np.ndarray, size: int, t: int, domain: int, empty: bool = False) -> tuple[np.ndarray, bool]:
    """Signatures of one instance over the features ``s`` of a set of ``size``, and whether they suffice.

    A part keeps an equal choice that is not empty until K2 + 1 of its cells differ, or all its filled ones
    if these are fewer. A pair differs in at most d cells, so if all parts together need more than d, a
    similar set shares a choice that is not empty. ``empty`` gives the empty choices instead.
    """
    parts, top = parts_of(t)
    d = (size + min(4 * size // 3, top)) // 7
    cell = (mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts * N2)).astype(np.int64)
    content = np.zeros(parts * N2, np.uint64)
    np.add.at(content, cell, s)
    filled = (np.bincount(cell, minlength=parts * N2) > 0).reshape(parts, N2)
    content = content.reshape(parts, N2)
    safe = int(np.minimum(filled.sum(1), K2 + 1).sum()) > d
    name = np.arange(parts, dtype=np.uint64) + np.uint64((2 * t + domain) << 40)
    out = []
    for c, chosen in enumerate(combinations(range(N2), N2 - K2)):
        chosen = list(chosen)
        h = mix(name + np.uint64((c + 1) << 56))
        for k in chosen:
            h = mix(h ^ content[:, k])
        held = filled[:, chosen].any(1)
        out.append(h[~held if empty else held])
    return np.concatenate(out), safe


def sketch(s: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parity of the features in each cell: two sets differ in at least as many features as parities.

    The cells are the power of two from twice the set's size, 512 at least, or as many as ``words`` hold.
    Halves of a longer sketch, folded by exclusive or, are the shorter one.
    """
    bits = 64 * (words or max(SKETCH_WORDS, (1 << (2 * len(s) - 1).bit_length()) >> 6))
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_key(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(np.array([len(s)], np.uint64) + mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).view(np.int64)[0])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables("shingles")
    for batch in small(batches):
        n, key, parity = [], [], []
        for s in sets(batch.column("text")):
            n.append(len(s))
            key.append(set_key(s) if len(s) else None)
            parity.append(sketch(s).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (*LOCATOR, "doc_id")), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(parity, pa.list_(pa.int64()))],
            names=[*LOCATOR, "doc_id", "n_shingles", "key", "parity"])


def describe(docs: DataFrame) -> DataFrame:
    """One slim row per document: locator, id, set size, name of the set and parity sketch."""
    rows = located(docs, [F.col("doc_id"), F.col("text")])
    kind = dict(rows.dtypes)
    return rows.mapInArrow(_describe, f"src_file string, src_row long, doc_id {kind['doc_id']}, n_shingles long, key long, parity array<long>")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        got = list(sets(batch.column("text")))
        key, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])


def frequent_shingles(docs: DataFrame, rows: int, sample: int = SAMPLE, share: float = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Shingles in at least ``share`` of a sample of documents, ``most`` of them at most.

    They only steer which signatures are made: any set of shingles gives the same links.
    """
    slot = F.pmod(F.xxhash64(*LOCATOR), F.lit(1 << 30)) / float(1 << 30)
    some = located(docs, [F.col("text")]).filter(slot < sample / max(rows, 1)).select("text")
    counts = some.mapInArrow(_tally, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(4, round(share * min(sample, rows)))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(np.asarray(top["shingle"]).astype(np.int64).view(np.uint64))


PACKED = "part int, n int, wide int, sigs binary, idx binary, names binary"


NAME = np.dtype([("key", "<i8")])
TOLD = np.dtype([("key", "<i8"), ("comp", "<i8"), ("size", "<i8"), ("parity", "<u8", (SKETCH_WORDS,))])


def _pack(dealt: Deal, sigs: list[list[tuple[int, np.ndarray]]], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures of a slab by part: 32 bits of each (beside the part), its set's index, and what is told of the sets."""
    if not sigs:
        return
    sig = np.concatenate([x for own in sigs for _, x in own])
    owner = np.repeat(np.arange(len(sigs)), [sum(len(x) for _, x in own) for own in sigs]).astype(np.uint32)
    instance = np.repeat([t for own in sigs for t, _ in own], [len(x) for own in sigs for _, x in own])
    part = dealt.part(instance, sig)
    order = np.argsort((part << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF)))
    sig, owner, part = sig[order].astype(np.uint32), owner[order], part[order]
    edges = np.searchsorted(part, np.arange(dealt.parts + 1, dtype=np.uint64))
    rows: list[list] = [[], [], [], [], [], []]
    for p in np.flatnonzero(np.diff(edges)):
        a, b = int(edges[p]), int(edges[p + 1])
        held, local = np.unique(owner[a:b], return_inverse=True)
        idx = local.astype(np.uint16 if len(held) <= 65536 else np.uint32)
        steps = np.diff(sig[a:b], prepend=np.uint32(0))  # sorted, so steps are small
        for into, x in zip(rows, (int(p), b - a, idx.itemsize, _squeezed(steps), _squeezed(idx), names[held].tobytes())):
            into.append(x)
    yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int32()) for r in rows[:3]), *(pa.array(r, pa.binary()) for r in rows[3:])], names=["part", "n", "wide", "sigs", "idx", "names"])


def _squeezed(x: np.ndarray) -> bytes:
    """Byte planes, compressed: the high ones hold little."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _spread_out(raw: bytes, n: int, kind: np.dtype) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _emit(dealt: Deal, frequent: np.ndarray):
    """Packed signatures of a table of texts, equal sets of a slab once; where comp is told, facts of the sets go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, names, seen, held, kind = [], [], set(), 0, NAME
        for batch in small(batches):
            told = "comp" in batch.schema.names
            kind = TOLD if told else NAME
            comps = iter(batch.column("comp").to_pylist()) if told else None
            for s in sets(batch.column("text")):
                comp = next(comps) if told else None
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                sigs.append(by_instance(s, frequent))
                names.append((key, comp, len(s), sketch(s, SKETCH_WORDS).view(np.uint64)) if told else (key,))
                held += sum(len(x) for _, x in sigs[-1])
                if held > 1_000_000:
                    yield from _pack(dealt, sigs, np.array(names, kind))
                    sigs, names, seen, held = [], [], set(), 0
        if sigs:
            yield from _pack(dealt, sigs, np.array(names, kind))

    return run


def _buckets(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared buckets of one part: starts of runs, run of each row, set of each row, and what is told of the sets.

    Sets are numbered by key, so equal sets of different slabs are one and a bucket begins with its smallest
    key. Rows are sorted as one number, signature above set, so a part takes two words a row.
    """
    told = np.concatenate([np.frombuffer(names, kind) for names in table.column("names").to_pylist()])
    _, first, number = np.unique(told["key"], return_index=True, return_inverse=True)
    number = number.astype(np.uint64)
    rows, base = [], 0
    for n, wide, sigs, idx, names in zip(*(table.column(c).to_pylist() for c in ("n", "wide", "sigs", "idx", "names"))):
        sig = np.cumsum(_spread_out(sigs, n, np.uint32), dtype=np.uint32).astype(np.uint64)
        rows.append((sig << np.uint64(32)) | number[base + _spread_out(idx, n, np.uint16 if wide == 2 else np.uint32).astype(np.int64)])
        base += len(names) // kind.itemsize
    row = np.concatenate(rows)
    rows.clear()
    row.sort()
    row = row[np.concatenate([[True], row[1:] != row[:-1]])]
    same = (row[1:] >> np.uint64(32)) == (row[:-1] >> np.uint64(32))
    row = row[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    sig = (row >> np.uint64(32)).astype(np.uint32)
    opens = np.concatenate([[True], sig[1:] != sig[:-1]])[:len(sig)]
    return np.flatnonzero(opens), np.cumsum(opens) - 1, (row & np.uint64(0xFFFFFFFF)).astype(np.int64), told[first]


def _coded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of set numbers as one number."""
    return (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)


def _stars(table: pa.Table) -> pa.Table:
    start, run, at, told = _buckets(table, NAME)
    key = told["key"]
    hub = at[start][run]
    tie = hub != at
    crowd = np.diff(start, append=len(at))[run] > 2
    pair, n = np.unique(_coded(hub[tie], at[tie]), return_counts=True)
    a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    crowded = np.isin(pair, _coded(hub[tie & crowd], at[tie & crowd]))
    out = pa.table({"a": key[a], "b": key[b], "n": n.astype(np.int64), "crowded": crowded})
    give_back()
    return out


def stars(docs: DataFrame, dealt: Deal, frequent: np.ndarray) -> DataFrame:
    """(a, b, n, crowded): each set of a shared bucket tied to the bucket's hub, the number of buckets that tie them,
    and whether one of these holds a third set."""
    packed = docs.select("text").mapInArrow(_emit(dealt, frequent), PACKED)
    ties = packed.groupBy("part").applyInArrow(_stars, "a long, b long, n long, crowded boolean")
    return ties.groupBy("a", "b").agg(F.sum("n").alias("n"), F.bool_or("crowded").alias("crowded"))


def bounded(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and parity sketches allow the threshold.

    Where the sizes do, one sketch is at most twice as long as the other, and folded once.
    """
    def alike(p: str, q: str) -> Column:
        half = (F.size(p) / 2).cast("int")
        halves = F.zip_with(F.slice(p, 1, half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(p) > F.size(q), halves).otherwise(F.col(p))

    for c in "ab":
        pairs = pairs.join(sizes.select(F.col("key").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("parity").alias(f"p{c}")), c)
    apart = F.aggregate(F.zip_with(alike("pa", "pb"), alike("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")) & (7 * apart <= F.col("na") + F.col("nb"))
    return pairs.filter(fits)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        got = list(sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s.tobytes() for s in got], pa.binary())], names=["key", "features"])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep and more columns) with the text of each row's document.

    While the wanted locators are few by their written size, they go to the scan, so that no other text
    moves; beyond that, texts and locators meet in a shuffle.
    """
    at = materialise(wanted.select(F.xxhash64("rep.src_file", "rep.src_row").alias("slot"), "rep.src_row", *(c for c in wanted.columns if c != "rep")), "sets-wanted")
    few = at.count() * 64 <= BROADCAST_BYTES  # bytes of a row in memory, at most
    texts = located(docs, [F.col("text")]).withColumn("slot", F.xxhash64(*LOCATOR)).drop("src_file")
    return texts.join(F.broadcast(at) if few else at, ["slot", "src_row"])


def full_sets(docs: DataFrame, sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, features) of the wanted sets, each from the text of one document that has it."""
    at = sizes.join(wanted, "key", "left_semi").select("key", "rep")
    return texts_of(docs, at).select("key", "text").mapInArrow(_sets_of, "key long, features binary")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("fa"), batch.column("fb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= 75 * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def verify(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, linked) by the exact size of intersection and union. A hub with many partners is a skewed join key."""
    left = pairs.select("a", "b").join(features.select(F.col("key").alias("b"), F.col("features").alias("fb")), "b")
    both = left.join(features.select(F.col("key").alias("a"), F.col("features").alias("fa")), "a")
    return both.select("a", "b", "fa", "fb").mapInArrow(_linked, "a long, b long, linked boolean")


def _rest(table: pa.Table) -> pa.Table:
    """Pairs of one part's buckets in different components that pass the size and sketch bounds."""
    start, run, at, told = _buckets(table, TOLD)
    key, comp, size, parity = (np.ascontiguousarray(told[f]) for f in ("key", "comp", "size", "parity"))
    found, loose = [np.zeros(0, np.uint64)], 0
    if len(at):
        own = comp[at]
        mixed = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start))[run]
        run, at = run[mixed], at[mixed]
    i, step = np.arange(len(run)), 0
    while len(i):  # rows that have a row of their bucket ``step`` places on
        step += 1
        i = i[i + step < len(run)]
        i = i[run[i + step] == run[i]]
        for a in range(0, len(i), 1 << 17):
            x, y = at[i[a:a + (1 << 17)]], at[i[a:a + (1 << 17)] + step]
            ok = comp[x] != comp[y]
            x, y = x[ok], y[ok]
            ok = 100 * np.minimum(size[x], size[y]) >= 75 * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            ok = 7 * np.bitwise_count(parity[x] ^ parity[y]).sum(1, dtype=np.int64) <= size[x] + size[y]
            if ok.any():
                found.append(np.unique(_coded(np.minimum(x[ok], y[ok]), np.maximum(x[ok], y[ok]))))
                loose += len(found[-1])
                if loose > 1 << 20:
                    found, loose = [np.unique(np.concatenate(found))], 0
    pairs = np.unique(np.concatenate(found))
    out = pa.table({"a": key[(pairs >> np.uint64(32)).astype(np.int64)], "b": key[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]})
    give_back()
    return out


def remaining(docs: DataFrame, state: DataFrame, dealt: Deal, frequent: np.ndarray) -> DataFrame:
    """Pairs (a, b) that share a bucket, are in different components and may reach the threshold.

    ``state`` has rep and comp of every set in a crowded bucket of several components; only their texts are read again.
    """
    packed = texts_of(docs, state.select("rep", "comp")).select("text", "comp").mapInArrow(_emit(dealt, frequent), PACKED)
    return packed.groupBy("part").applyInArrow(_rest, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Locator, doc_id, n_shingles, component_id and kept (the row that stands for its component).

    * Null and empty texts and texts without words have no shingle, link with nothing and are kept.
    * Repeated rows and texts with equal sets are one component; its id is the smallest doc_id.
      Of rows that repeat that id too, the first by locator is kept. A null doc_id is the smallest.
    * An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = materialise(describe(docs), "sets-described")
    sizes = told.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("doc_id", *LOCATOR)).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"))
    sizes = materialise(sizes, "sets-distinct")
    frequent = frequent_shingles(docs, told.count())
    raw = materialise(stars(docs, deal(told), frequent), "sets-stars")
    _drop_shuffles(spark)
    ties = materialise(bounded(raw, sizes).select("a", "b", "n"), "sets-ties")

    wanted = ties.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    features = materialise(full_sets(docs, sizes, wanted), "sets-features")
    # Most shared buckets first; the other ties of a set only where that one left it apart.
    best = ties.groupBy("b").agg(F.max_by("a", "n").alias("a"))
    links = materialise(verify(best, features).filter("linked").select("a", "b"), "sets-links")
    comp = components(links)
    more = materialise(verify(_apart(ties, comp), features).filter("linked").select("a", "b"), "sets-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = components(links)
    # Two members of a bucket may be similar where neither is similar to its hub.
    # Such a bucket has three or more members, one of them apart from its hub, and all are tied to that hub.
    crowded = raw.filter("crowded")
    hubs = materialise(_apart(crowded, comp).select("a").distinct(), "sets-hubs")
    if not hubs.isEmpty():
        wide = crowded.join(hubs, "a", "left_semi").select(F.explode(F.array("a", "b")).alias("key")).distinct()
        state = sizes.join(wide, "key", "left_semi").join(comp.withColumnRenamed("node", "key"), "key", "left").select(
            "rep", "n_shingles", F.coalesce("comp", "key").alias("comp"))
        state = materialise(state, "sets-state")
        _drop_shuffles(spark)
        rest = materialise(remaining(docs, state, deal(state), frequent), "sets-rest")
        rest = materialise(bounded(rest, sizes).select("a", "b"), "sets-rest")
        if not rest.isEmpty():
            wanted = rest.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            last = materialise(verify(rest, full_sets(docs, sizes, wanted)).filter("linked").select("a", "b"), "sets-links")
            if not last.isEmpty():
                comp = components(links.unionByName(last))

    named = sizes.select("key", "rep").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    heads = named.groupBy("comp").agg(F.min("rep").alias("head"))
    named = materialise(named.join(heads, "comp").select("key", "head"), "sets-heads")
    out = told.join(named, "key", "left").select(
        *LOCATOR, "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (F.col("key").isNull() | (F.struct(*LOCATOR) == F.struct("head.src_file", "head.src_row"))).alias("kept"))
    return out


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps, whose results are written, before the next large step."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _apart(ties: DataFrame, comp: DataFrame) -> DataFrame:
    """Ties whose ends are in different components."""
    a, b = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    return ties.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with all their columns."""
    docs = file_backed(docs)
    kept = classes(docs).filter("kept").select(*(F.col(c).alias(f"_kept_{c}") for c in LOCATOR))
    meta = docs.metadataColumn("_metadata")
    return docs.join(kept, (meta.getField("file_path") == F.col("_kept_src_file")) & (meta.getField("row_index") == F.col("_kept_src_row")), "left_semi")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(file_backed(documents(spark, sf_dir))).select("doc_id", "n_shingles", "component_id")
