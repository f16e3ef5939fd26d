"""Phrase collocations with Misra-Gries summaries per hash partition and an exact second pass.

First pass: every phrase occurrence becomes a fingerprint; its leading bits name a hash partition. Tasks
send one packet of fingerprints and counts per partition, and a partition folds the packets into one
Misra-Gries summary. Its capacity exceeds the partition's mass divided by the threshold, so what is
subtracted stays below the threshold, and a phrase can only be frequent if its counter plus all that
was subtracted reaches it. Second pass: occurrences that pass a bit filter of the surviving
fingerprints, and whose shorter parts pass too, are counted exactly as words, never as fingerprints.
The filter has a fixed size; if it fills up, more is shuffled and the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialise, ship_package
from .chunks import give_back, slabs
from .common import documents
from .shingles import mix
from .terms import coded_spans

LONGEST = 5
SLAB_BYTES = 4 << 20
FLUSH = 3_000_000  # entries a task holds before it sends packets
PART_MASS = 1 << 24  # phrase occurrences a hash partition is planned for
SLACK = 4  # capacity over mass / threshold
FILTER_WORDS = 1 << 22  # 64-bit words of the broadcast filter: 32 MB at most
SPARE_BITS = 6  # bits of a fingerprint beyond those that number all occurrences
PART_PHRASES = 1 << 17  # frequent phrases a partition of the second pass is planned for
BUFFER = 1_000_000  # entries joined to a summary at once

_KIND = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SALT = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of some texts in order: local word numbers, the distinct words, the piece and language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.distinct, self.ids, doc, first, data = coded_spans(texts, _KIND == 0)
        self.piece = np.cumsum(_KIND[data] == 2, dtype=np.int32)[first] + doc if len(first) else doc
        tongue = langs.dictionary_encode()
        self.langs = tongue.dictionary.to_pylist()
        self.lang = np.asarray(tongue.indices)[doc]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of each word and of its language."""
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))
        lang = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))
        return word[self.ids], lang[self.lang]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for a, b in slabs(batch.column("text"), SLAB_BYTES):
            part = batch.slice(a, b - a)
            yield Words(part.column("text"), part.column("lang"))
        give_back()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in _read(batches):
        key, n = np.unique(w.lang.astype(np.int64) * len(w.distinct) + w.ids, return_counts=True)
        words = pa.array(w.distinct, pa.binary()).take(pa.array(key % max(len(w.distinct), 1))).cast(pa.string())
        langs = pa.array(w.langs, pa.string()).take(pa.array(key // max(len(w.distinct), 1)))
        yield pa.RecordBatch.from_arrays([langs, words, pa.array(n, pa.int64())], names=["lang", "phrase", "a"])


def _phrases(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, whether it lies in one piece) of the phrase that starts at each word, by length."""
    word, h = w.hashes()
    h = h * _STEP + word
    for k in range(2, LONGEST + 1):
        n = max(len(word) - k + 1, 0)
        h = h[:n] * _STEP + word[len(word) - n:]
        yield k, h, w.piece[:n] == w.piece[len(word) - n:]


def _fold(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their counts. The parts are sorted, which the stable sort uses."""
    f, c = np.concatenate(prints), np.concatenate(counts)
    if len(prints) > 1:
        order = np.argsort(f, kind="stable")
        f, c = f[order], c[order]
    if not len(f):
        return f, c
    new = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    return f[new], np.add.reduceat(c, new)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes of small numbers cost next to nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T), codec="zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(np.uint64)


PACKET = "part long, size int, mass long, gaps binary, counts binary"


def _packets(bits: int, part_bits: int):
    """Fingerprints and counts of a task's phrases, one packet per hash partition."""
    shift, rest = np.uint64(64 - bits), np.uint64(bits - part_bits)

    def flush(prints: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        f, c = _fold(prints, counts)
        part = f >> rest
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(f) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            gaps = np.diff(f[a:b], prepend=np.uint64(0))
            row = [[int(part[a])], [int(b - a)], [int(c[a:b].sum())], [_planes(gaps)], [_planes(c[a:b].astype(np.uint64))]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
                                             names=["part", "size", "mass", "gaps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, held = [], [], 0
        for w in _read(batches):
            f = np.sort(np.concatenate([(mix(h[ok]) >> shift) for _, h, ok in _phrases(w)]))
            f, c = _fold([f], [np.ones(len(f), np.int64)])
            prints.append(f)
            counts.append(c)
            held += len(f)
            if held >= FLUSH:
                yield from flush(prints, counts)
                prints, counts, held = [], [], 0
                give_back()
        if held:
            yield from flush(prints, counts)
        del prints, counts
        give_back()

    return run


class Summary:
    """A Misra-Gries summary. ``lost`` is what any fingerprint may have lost at most; it stays below the threshold."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.lost = capacity, threshold, 0
        self.prints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, prints: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.prints, self.counts = _fold([self.prints, *prints], [self.counts, *counts])
        over = len(self.counts) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            if self.lost + cut < self.threshold:  # always so while the mass is as planned; else the summary grows
                keep = self.counts > cut
                self.prints, self.counts = self.prints[keep], self.counts[keep] - cut
                self.lost += cut

    def survivors(self) -> np.ndarray:
        return self.prints[self.counts + self.lost >= self.threshold]


def _summaries(capacity: int, threshold: int):
    """Folds packets, sorted by partition, into one summary after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, summary, prints, counts, held = None, None, [], [], 0

        def done() -> pa.RecordBatch:
            summary.add(prints, counts)
            return pa.RecordBatch.from_arrays([pa.array(summary.survivors().astype(np.int64), pa.int64())], names=["print"])

        for batch in batches:
            for i in range(batch.num_rows):
                part, n = batch.column("part")[i].as_py(), batch.column("size")[i].as_py()
                if part != at:
                    if summary is not None:
                        yield done()
                    at, summary, prints, counts, held = part, Summary(capacity, threshold), [], [], 0
                prints.append(np.cumsum(_numbers(batch.column("gaps")[i].as_py(), n), dtype=np.uint64))
                counts.append(_numbers(batch.column("counts")[i].as_py(), n).astype(np.int64))
                held += n
                if held >= BUFFER:
                    summary.add(prints, counts)
                    prints, counts, held = [], [], 0
        if summary is not None:
            yield done()
        give_back()

    return run


def _slots(prints: np.ndarray, log_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter word and four bits of it for each fingerprint."""
    g = mix(prints + _SALT)
    mask = np.zeros(len(g), np.uint64)
    for j in range(4):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * j)) & np.uint64(63))
    return (g >> np.uint64(64 - log_words)).astype(np.int64), mask


def _filter_rows(log_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = _slots(np.asarray(batch.column("print")).astype(np.uint64), log_words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], names=["at", "mask"])

    return run


def _exact(ids: np.ndarray, sizes: np.ndarray, lang: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal phrases (same words, length and language) side by side become one row; equal hashes alone never join."""
    order = np.argsort(h, kind="stable")
    ids, sizes, lang, h, n = ids[order], sizes[order], lang[order], h[order], n[order]
    same = (h[1:] == h[:-1]) & (sizes[1:] == sizes[:-1]) & (lang[1:] == lang[:-1]) & (ids[1:] == ids[:-1]).all(1)
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    return ids[new], sizes[new], lang[new], h[new], np.add.reduceat(n, new)


COUNTED = "part long, lang string, k int, size int, phrases binary, counts binary"


def _count_phrases(sieve, log_words: int, bits: int, part_bits: int):
    """Exact counts of the task's phrases that pass the filter, one packet per partition, language and length."""
    shift, part_shift = np.uint64(64 - bits), np.uint64(64 - part_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sieve.value, np.uint64)
        words: dict[bytes, int] = {}
        tongues: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids, sizes, lang, h, n = _exact(*(np.concatenate(x) for x in zip(*held)))
                names, langs = list(words), list(tongues)
                part = (h >> part_shift).astype(np.int64)
                order = np.lexsort((sizes, lang, part))
                ids, sizes, lang, n, part = ids[order], sizes[order], lang[order], n[order], part[order]
                new = (part[1:] != part[:-1]) | (lang[1:] != lang[:-1]) | (sizes[1:] != sizes[:-1])
                cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(n)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    k = int(sizes[a])
                    text = b"\n".join([b" ".join([names[j] for j in row]) for row in ids[a:b, :k].tolist()])  # no word holds a line break
                    row = [[int(part[a])], [langs[lang[a]]], [k], [b - a], [zstandard.compress(text)], [_planes(n[a:b].astype(np.uint64))]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])],
                                                     names=["part", "lang", "k", "size", "phrases", "counts"])
            held.clear()
            words.clear()
            tongues.clear()
            give_back()

        for w in _read(batches):
            if sum(len(x[0]) for x in held) >= FLUSH // 2 or len(words) >= FLUSH // 2:
                yield from flush()
            number = np.fromiter((words.setdefault(x, len(words)) for x in w.distinct), np.int32, len(w.distinct))
            spoken = np.fromiter((tongues.setdefault(x, len(tongues)) for x in w.langs), np.int32, len(w.langs))
            passed, parts = None, []
            for k, h, ok in _phrases(w):
                if passed is not None:
                    ok = ok & passed[:len(ok)] & passed[1:len(ok) + 1]
                at = np.flatnonzero(ok)
                full = mix(h[at])
                slot, mask = _slots(full >> shift, log_words)
                hit = (bitmap[slot] & mask) == mask
                at, full = at[hit], full[hit]
                passed = np.zeros(len(ok), bool)
                passed[at] = True
                ids = np.full((len(at), LONGEST), -1, np.int32)
                for j in range(k):
                    ids[:, j] = number[w.ids[at + j]]
                parts.append(_exact(ids, np.full(len(at), k, np.int8), spoken[w.lang[at]], full, np.ones(len(at), np.int64)) if len(at) else None)
            held.extend(p for p in parts if p is not None)
        yield from flush()

    return run


def _summed(threshold: int):
    """Sums packets, sorted by partition, language and length; gives the phrases that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, {}

        def done() -> pa.RecordBatch:
            often = [(p, n) for p, n in total.items() if n >= threshold]
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(often), pa.string()), pa.array([p for p, _ in often], pa.binary()).cast(pa.string()),
                                               pa.array([at[2]] * len(often), pa.int32()), pa.array([n for _, n in often], pa.int64())], names=["lang", "phrase", "k", "a"])

        for batch in batches:
            for row in batch.to_pylist():
                key = row["part"], row["lang"], row["k"]
                if key != at:
                    if at is not None:
                        yield done()
                    at, total = key, {}
                for phrase, n in zip(zstandard.decompress(row["phrases"]).split(b"\n"), _numbers(row["counts"], row["size"]).tolist()):
                    total[phrase] = total.get(phrase, 0) + n
        if at is not None:
            yield done()
        give_back()

    return run


def frequent_phrases(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, k, a): of all words (k = 1), and of phrases of 2 to 5 words with a >= threshold."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(rows.mapInArrow(_count_words, "lang string, phrase string, a long").groupBy("lang", "phrase")
                        .agg(F.sum("a").alias("a")).select("lang", "phrase", F.lit(1).alias("k"), "a"), "words")
    mass = (LONGEST - 1) * (words.agg(F.sum("a")).first()[0] or 0)
    part_bits = max(mass // PART_MASS, 1).bit_length()
    bits = min(max(mass, 1).bit_length() + SPARE_BITS, 62)
    part_bits = min(part_bits, bits)
    capacity = SLACK * (mass // threshold // (1 << part_bits)) + 1024
    packets = rows.mapInArrow(_packets(bits, part_bits), PACKET).repartition(1 << part_bits, "part").sortWithinPartitions("part")
    found = materialise(packets.select("part", "size", "gaps", "counts").mapInArrow(_summaries(capacity, threshold), "print long"), "prints")
    n_found = found.count()
    log_words = min(max(n_found * 24 // 64, 64).bit_length(), FILTER_WORDS.bit_length() - 1)
    bitmap = np.zeros(1 << log_words, np.uint64)
    masks = found.mapInArrow(_filter_rows(log_words), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap[np.asarray(masks["at"])] = np.asarray(masks["mask"]).view(np.uint64)
    sieve = spark.sparkContext.broadcast(bitmap.tobytes())
    part_bits = max(n_found // PART_PHRASES, 8).bit_length()
    counted = rows.mapInArrow(_count_phrases(sieve, log_words, bits, part_bits), COUNTED).repartition(1 << part_bits, "part")
    counted = counted.sortWithinPartitions("part", "lang", "k").mapInArrow(_summed(threshold), "lang string, phrase string, k int, a long")
    return words, materialise(counted, "phrases")


def _words_between(phrase: Column, a: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), a, n), " ")


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words seen ``threshold`` times or more.

    A null text counts as empty, a null lang as ``und``; repeated rows count as often as they occur. Other
    columns are not read. Ties go to the more frequent phrase, then to the phrase first in byte order. Without
    frequent phrases there are no rows. A phrase gives way to a longer one that holds it and is as frequent.
    """
    words, phrases = frequent_phrases(docs, threshold)
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    part = words.filter(F.col("a") >= threshold).select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    # A longer phrase that is as frequent has a link of one word more that is as frequent, so those suffice.
    held = phrases.filter("k > 2").select("lang", "a", F.explode(F.array_distinct(F.array(
        _words_between(F.col("phrase"), 1, F.col("k") - 1), _words_between(F.col("phrase"), 2, F.col("k") - 1)))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = phrases.join(held, ["lang", "phrase"], "left").filter(F.coalesce("longer", F.lit(0)) < F.col("a")).drop("longer")
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("_l", _words_between(F.col("phrase"), 1, F.col("cut"))).withColumn("_r", _words_between(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")))
    left = part.select("lang", F.col("phrase").alias("_l"), F.col("a").alias("l"))
    right = part.select("lang", F.col("phrase").alias("_r"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).join(total, "lang")
    score = F.expr("CAST(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) ks)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 100),
inside AS (
  SELECT DISTINCT c.lang, s.phrase, c.a FROM c,
    LATERAL (SELECT array_to_string(c.w[i:i + m - 1], ' ') AS phrase FROM (SELECT unnest(range(2, c.k)) AS m) ms, LATERAL (SELECT unnest(range(1, c.k - m + 2)) AS i) t) s
), kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, j, l.a AS l, r.a AS r, n.n,
    CAST((1000::HUGEINT * cut.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ') AND l.k = j
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:], ' ') AND r.k = cut.k - j JOIN n ON n.lang = cut.lang
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""
