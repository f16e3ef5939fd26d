"""Language identification by prediction by partial matching.

Each learned language has a byte context tree of order ``ORDER`` with method-C escapes: a context with n
counts of t different bytes gives a seen byte c / (n + t) and the escape t / (n + t); below order 0
all 256 bytes are alike. Statistics are frozen after training, so the code length of a byte is a
function of the four last bytes, kept per node of one tree shared by all languages. A text's language
is the one with the shortest exact code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import small, utf8
from .common import crc_bucket, documents

ORDER = 3
SAMPLE_PER_LANGUAGE = 400  # labelled documents, about; the whole texts of these are counted
MAX_LANGUAGES = 500
MAX_NODES = 1 << 18  # deepest nodes kept, the most frequent ones
PAD = "\n" * ORDER  # context of a text's first bytes
EVIDENCE_BYTES = 24.0  # bytes whose code length counts in full towards the score
UNKNOWN = "und"


def training_rows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` documents of each language by a hash of doc_id; rows without text or lang are left out."""
    rows = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # One row per language, so the texts need not move before they are sampled.
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    return rows.join(F.broadcast(sizes), "lang").filter(share < per_language / F.col("n")).select("lang", "text")


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([PAD + (t or "").lower() for t in texts.to_pylist()], pa.large_string()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte (ORDER + 1)-grams by language within each batch."""
    for batch in small(batches):
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            data, starts = _folded(batch.column("text").filter(pa.array(langs == lang)))
            grams = _grams(data)
            inside = np.ones(len(data), bool)
            for k in range(ORDER):
                inside[np.minimum(starts[:-1] + k, len(data) - 1)] = False
            key, n = np.unique(grams[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _grams(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the three before it as one 32-bit number."""
    d = data.astype(np.uint32)
    out = d.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= d[:-k] << np.uint32(8 * k)
    return out


class Model:
    """Code lengths of every (context, byte) in all languages, as one tree over a reduced alphabet."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, n_langs = langs, len(langs)
        every = np.unique(np.concatenate([g for g, _ in counts]))
        used = np.unique(np.concatenate([(every >> np.uint32(8 * k)) & np.uint32(255) for k in range(ORDER + 1)]))
        self.symbol = np.zeros(256, np.int64)  # 0 stands for bytes never seen
        self.symbol[used] = np.arange(1, len(used) + 1)
        a = self.width = len(used) + 1
        # levels[d]: sorted keys of d+1 symbols; totals per language
        digits = [self.symbol[(every >> np.uint32(8 * k)) & np.uint32(255)] for k in range(ORDER, -1, -1)]
        place = np.zeros((len(every), n_langs))
        for j, (g, n) in enumerate(counts):
            place[np.searchsorted(every, g), j] = n
        full = np.full((1, n_langs), 8.0)  # order -1: 256 equal bytes
        self.esc: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        for d in range(ORDER + 1):  # strings of d+1 symbols: those coded, and those that are contexts only
            windows = []
            for j in range(ORDER - d + 1):
                key = np.zeros(len(every), np.int64)
                for x in digits[j:j + d + 1]:
                    key = key * a + x
                windows.append(key)
            keys = np.unique(np.concatenate(windows))
            c = np.zeros((len(keys), n_langs))
            np.add.at(c, np.searchsorted(keys, windows[-1]), place)
            ctx = keys // a
            groups, of = np.unique(ctx, return_inverse=True)
            n, t = np.zeros((len(groups), n_langs)), np.zeros((len(groups), n_langs))
            np.add.at(n, of, c)
            np.add.at(t, of, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(t / (n + t)), 0.0)
                seen = -np.log2(c / (n + t)[of])
            lower = full if d == 0 else self._of_lower(d, keys, full)
            full = np.where(c > 0, seen, escape[of] + lower)
            # node numbers: 0 is "not in the tree"
            table = np.zeros(a if d == 0 else (len(self.cost[-1])) * a, np.int32)
            parent = np.zeros(len(keys), np.int64) if d == 0 else self._node(d, keys // a)
            table[parent * a + keys % a] = np.arange(1, len(keys) + 1)
            self.index.append(table)
            self.cost.append(np.concatenate([np.zeros((1, n_langs)), full]).astype(np.float32))
            if d == 0:
                self.root_escape = escape[0]
            else:
                by_node = np.zeros((len(self.cost[d - 1]), n_langs), np.float32)
                by_node[self._node(d, groups)] = escape
                self.esc.append(by_node)
            self._levels = getattr(self, "_levels", []) + [keys]

    def _node(self, d: int, strings: np.ndarray) -> np.ndarray:
        """Node numbers at depth d of strings of d symbols that are in the tree as contexts."""
        keys = self._levels[d - 1]
        at = np.minimum(np.searchsorted(keys, strings), len(keys) - 1)
        return np.where(keys[at] == strings, at + 1, 0)

    def _of_lower(self, d: int, keys: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Code length of each string's last d symbols (they are in the tree, as the string is)."""
        return full[np.searchsorted(self._levels[d - 1], keys % self.width ** d)]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of every byte in every language, given the bytes before it."""
        s = self.symbol[data]
        a = self.width
        node = [self.index[0][s]]
        unseen = (self.root_escape + 8.0).astype(np.float32)
        bits = np.where((node[0] > 0)[:, None], self.cost[0][node[0]], unseen)
        for d in range(1, ORDER + 1):
            before = np.zeros(len(s), np.int64)
            before[1:] = node[-1][:-1]
            here = np.zeros(len(s), np.int32)
            known = before > 0
            here[known] = self.index[d][before[known] * a + s[known]]
            found = here > 0
            bits += self.esc[d - 1][before]
            bits[found] = self.cost[d][here[found]]
            node.append(here)
        return bits


def train(docs: DataFrame) -> Model | None:
    """The model of the training rows, or None without any. What reaches the driver is bounded by MAX_NODES per language."""
    counts = training_rows(docs).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept: dict[str, list] = {}
    from pyspark.sql import Window

    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= MAX_NODES)
    table = ranked.select("lang", "gram", "n").toArrow()
    for lang in sorted(set(table["lang"].to_pylist())):
        own = table.filter(pa.compute.equal(table["lang"], lang)).sort_by("gram")
        kept[lang] = [np.asarray(own["gram"]).astype(np.uint32), np.asarray(own["n"])]
    return Model(list(kept), [tuple(v) for v in kept.values()]) if kept else None


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in small(batches, 1 << 19):
            part = batch.column("text")
            letters = [t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()]
            lang, score = [UNKNOWN] * len(part), [0.0] * len(part)
            if model is not None:
                data, starts = _folded(part)
                total = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.code_lengths(data), axis=0, dtype=np.float64)])
                bits = total[starts[1:]] - total[starts[:-1] + ORDER]
                size = np.maximum(starts[1:] - starts[:-1] - ORDER, 1)
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / size[:, None] * np.minimum(size, EVIDENCE_BYTES)[:, None]
                sure = 1.0 / np.exp2(-gap).sum(1)
                for i, ok in enumerate(letters):
                    if ok:
                        lang[i], score[i] = model.langs[best[i]], float(sure[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (the code lengths' share of the best language over a few bytes of evidence).

    ``und`` with score 0 for null texts, texts without a letter, and without a model. Repeated rows give
    repeated rows; only doc_id and text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_NODES and the number of languages
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(crc_bucket(F.col("doc_id"), 5) != 0))
    return predict(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
