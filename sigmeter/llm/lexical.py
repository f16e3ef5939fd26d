"""Ranked lexical search by length buckets (LEMP).

A document's impact vector holds, for each query term in it, the impact of its occurrences; a score is
its inner product with the item's term weights. Impact vectors are ordered by their weighted length and
read in buckets from the longest on. Cauchy-Schwarz drops a bucket for an item whose ``top``-th score so
far it cannot reach; inside a bucket the largest impact of each coordinate bounds what the light terms
can add, so only the heavy ones are summed before candidates fall out. Survivors are rescored in 64-bit
integers. Items are taken in blocks of bounded size; thresholds are one number an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise, ship_package
from .chunks import give_back, slabs
from .common import documents, fold_ascii, table
from .terms import coded_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000  # (item, term) pairs of a block of items, about
SLAB_BYTES = 4 << 20
BUCKET_ROWS = 2048
PART_BYTES = 32 << 20
ROUNDS = (0.98, 0.85)  # shares of the documents, by length, below which the later rounds begin

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each. Rows that share an item_id are one item; rows without item_id or text are left out."""
    words = F.regexp_extract_all(fold_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    return items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.explode(words).alias("term")).distinct()


def _vectors(vocabulary):
    """(doc_id, n, terms, tfs): a document's number of terms, and of those in the vocabulary their numbers and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            for a, b in slabs(batch.column("text"), SLAB_BYTES):
                part = batch.slice(a, b - a)
                distinct, ids, doc, _, _ = coded_spans(part.column("text"), _TERM_BYTE)
                known = np.fromiter((number.get(x, -1) for x in distinct), np.int64, len(distinct))[ids]
                n = np.bincount(doc, minlength=b - a)
                key, tf = np.unique((doc << 32 | known)[known >= 0], return_counts=True)
                at = np.searchsorted(key >> 32, np.arange(b - a + 1))
                terms, tfs = (key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)), pa.array(n[some], pa.int64()), _sliced(terms, at).take(pa.array(some)), _sliced(tfs, at).take(pa.array(some))],
                    names=["doc_id", "n", "terms", "tfs"])
            give_back()

    return run


def _sliced(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows ``values[at[i]:at[i + 1]]`` of 32-bit numbers as binary."""
    offsets = np.ascontiguousarray(at * 4, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of binary rows, and the offset of each row."""
    arr = col.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2] or b"", np.int32)[offsets[0] // 4:offsets[-1] // 4], (offsets - offsets[0]) // 4


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, n = np.unique(_flat(batch.column("terms"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64())], names=["term", "df"])


def _impacts(weights, documents_: int, terms_: int):
    """Impacts and the length of the vector, where a coordinate counts with the root of its term's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            term, at = _flat(batch.column("terms"))
            tf = _flat(batch.column("tfs"))[0].astype(np.int64)
            m = 100 - 50 + 50 * np.asarray(batch.column("n")) * documents_ // terms_
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(at)))
            squares = np.concatenate([[0.0], np.cumsum(w[term] * impact.astype(float) ** 2)])
            length = np.sqrt(np.maximum(squares[at[1:]] - squares[at[:-1]], 0)) * (1 + 1e-6)  # never too short
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), batch.column("terms"), _sliced(impact.astype(np.int32), at)],
                                             names=["doc_id", "length", "terms", "impacts"])

    return run


class Bucket:
    """Documents of similar length: their vectors by row and by term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int):
        self.ids = batch.column("doc_id").to_pylist()
        self.length = np.asarray(batch.column("length"))
        self.terms, self.at = _flat(batch.column("terms"))
        self.impacts = _flat(batch.column("impacts"))[0].astype(np.int64)
        order = np.argsort(self.terms, kind="stable")
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))[order]
        self.posted = self.impacts[order]
        counts = np.bincount(self.terms, minlength=n_terms)
        self.hi = np.cumsum(counts)
        self.lo = self.hi - counts
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(counts)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.posted, self.lo[held])
        self.longest = float(self.length.max(initial=0))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)


def candidates(bucket: Bucket, terms: np.ndarray, weights: np.ndarray, least: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the bucket that score ``least`` or more, and their scores. Terms come heaviest first."""
    rest = np.concatenate([np.cumsum((weights * bucket.most[terms])[::-1])[::-1], [0]])
    cut = int((rest >= least).sum())  # beyond these terms no document reaches the threshold without them
    if not cut:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = bucket.lo[terms[:cut]], bucket.hi[terms[:cut]]
    at = _ranges(lo, hi)
    gain = np.repeat(weights[:cut], hi - lo).astype(float) * bucket.posted[at]
    doc = bucket.doc[at]
    got = np.bincount(doc, gain, len(bucket.ids))
    if cut < len(terms):
        square = np.bincount(doc, gain * bucket.posted[at], len(bucket.ids))
        left = np.sqrt(np.maximum(bucket.length ** 2 - square, 0)) * math.sqrt(weights[cut:].sum()) * (1 + 1e-6) + 1
        reach = got + np.minimum(left, rest[cut])
    else:
        reach = got
    rows = np.flatnonzero((got > 0) & (reach * (1 + 1e-9) >= least))
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    dense[terms] = weights
    lo, hi = bucket.at[rows], bucket.at[rows + 1]
    at = _ranges(lo, hi)
    score = np.add.reduceat(dense[bucket.terms[at]] * bucket.impacts[at], np.cumsum(hi - lo) - (hi - lo))
    dense[terms] = 0
    keep = score >= least
    return rows[keep], score[keep]


def _search(queries, floors: np.ndarray, n_terms: int, top: int):
    """The best rows of a task for each item, those only that reach the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value  # [(terms, weights)], heaviest term first
        lengths = np.array([math.sqrt(w.sum()) for _, w in asked])
        least, best = floors.copy(), [[] for _ in asked]
        dense = np.zeros(n_terms, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET_ROWS):
                bucket = Bucket(batch.slice(a, BUCKET_ROWS), n_terms)
                for q in np.flatnonzero(lengths * bucket.longest * (1 + 1e-9) + 1 >= least):
                    rows, score = candidates(bucket, *asked[q], int(least[q]), dense)
                    if len(rows):
                        best[q] += [(-s, bucket.ids[r]) for r, s in zip(rows.tolist(), score.tolist())]
                        best[q].sort()
                        del best[q][top:]
                        if len(best[q]) == top:
                            least[q] = max(least[q], -best[q][-1][0])
            give_back()
        for q, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array([d for _, d in rows]), pa.array([-s for s, _ in rows], pa.int64())],
                                                 names=["q", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, pairs: list, top: int, mass: list) -> DataFrame:
    """Lists of one block of items. ``mass`` holds N and L once the first block has counted them."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    vocabulary = sorted({r["term"].encode() for r in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted({r["item_id"] for r in pairs})
    of = {x: i for i, x in enumerate(ids)}
    held: list[list[int]] = [[] for _ in ids]
    for r in pairs:
        held[of[r["item_id"]]].append(number[r["term"].encode()])
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = materialise(docs.mapInArrow(_vectors(context.broadcast(number)), f"doc_id {kind}, n long, terms binary, tfs binary"), "lexical-terms")
    if not mass:
        mass += raw.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = mass
    count = np.zeros(len(vocabulary), np.int64)
    df = raw.select("terms").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    count[np.asarray(df["term"])] = np.asarray(df["df"])
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in count], np.int64)
    asked = []
    for terms in held:
        t = np.array(sorted(terms, key=lambda i: (-weight[i], i)), np.int64)
        asked.append((t, weight[t]))
    size = raw.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    parts = max(2 * context.defaultParallelism, 2 * size // PART_BYTES + 1)
    impacts = raw.filter("octet_length(terms) > 0").mapInArrow(_impacts(context.broadcast(weight), n_docs, n_terms), f"doc_id {kind}, length double, terms binary, impacts binary")
    by_length = materialise(impacts.repartitionByRange(parts, F.desc("length")).sortWithinPartitions(F.desc("length")), "lexical-lengths")
    marks = by_length.agg(F.percentile_approx("length", list(ROUNDS))).first()[0] or [0.0] * len(ROUNDS)
    queries, floors, lists = context.broadcast(asked), np.ones(len(ids), np.int64), None
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    for above, below in zip([None, *marks], [*marks, None]):
        rows = by_length
        if above is not None:
            rows = rows.filter(F.col("length") < above)
        if below is not None:
            rows = rows.filter(F.col("length") >= below)
        found = rows.mapInArrow(_search(queries, floors, len(vocabulary), top), f"q int, doc_id {kind}, score long")
        lists = found if lists is None else lists.unionByName(found)
        lists = materialise(lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank"), "lexical-lists")
        reached = lists.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= top).collect()
        for r in reached:
            floors[r["q"]] = r["least"]
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"q int, item_id {kind_of(ids)}")
    ranked = lists.withColumn("rank", F.row_number().over(order))
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def kind_of(ids: list) -> str:
    return "string" if ids and isinstance(ids[0], str) else "long"


def search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending doc_id. Null and empty texts hold no terms; documents without doc_id are
    left out, repeated rows are documents of their own. Items without terms, and empty tables, give no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    terms = materialise(item_terms(items), "item-terms")
    blocks = terms.count() // BLOCK_TERMS + 1
    out, mass = None, []
    for b in range(blocks):
        pairs = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # one bounded block of items
        if pairs:
            found = _search_block(rows, pairs, top, mass)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), d AS (
  SELECT tf.doc_id, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))) AS part
  FROM tf JOIN len USING (doc_id) JOIN w USING (term), s
), r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN d USING (term) GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM z WHERE rank <= 50
"""
