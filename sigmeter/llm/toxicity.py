"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word openings is learned from labelled training rows by smoothed log odds of
document frequencies, so that inflected forms count as well. The
features of a text are the densities of lexicon words, their nearness to second-person words, capitals,
punctuation and obfuscation rates. Lexicon, trees and isotonic curve each learn from their own part of
the training rows, so none sees another's errors as truth. Only texts enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from .chunks import small
from .common import crc_bucket, documents, table

FIT_ROWS = 12000  # labelled rows that are learned from, about
LEXICON = 600  # words and word openings in the learned lexicon
OPENINGS = range(3, 9)  # lengths of word openings, written with a final hyphen
MIN_ODDS = 1.5  # least log odds of a lexicon word, two standard errors below the estimate
THRESHOLD = 0.3
YOU = frozenset("you your yours youre u ya du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ti usted tú vos".split())
NEAR = 6
WORD = re.compile(r"[\w@$*]+")
LEET = str.maketrans("01345@$7", "oieasast")
INSIDE = re.compile(r"[^\W\d_][\d@$*_]+[^\W\d_]")
FEATURES = ["density", "weight", "strongest", "hits_log", "distinct_log", "near_you", "capitals", "punctuation", "shouts", "obfuscated", "hidden_hits", "length_log"]


class Lexicon(dict):
    """Word or opening -> log odds; ``of`` finds a word's strongest entry and remembers it."""

    def __init__(self, *a):
        super().__init__(*a)
        self.memo: dict[str, tuple[float, bool]] = {}

    def of(self, w: str) -> tuple[float, bool]:
        """(log odds or 0, whether it shows only without disguise characters)."""
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            bare = w.strip("@$*_")
            plain = bare if bare.isalpha() else bare.translate(LEET).replace("*", "").replace("_", "")
            keys = [plain, *(plain[:k] + "-" for k in OPENINGS if len(plain) >= k)]
            got = self.memo[w] = (max((self.get(k, 0.0) for k in keys), default=0.0), plain != bare)
        return got


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    of = lexicon.of
    hits = [(i, got[0], w, got[1]) for i, (w, got) in enumerate(zip(words, map(of, words))) if got[0]]
    hidden = sum(h[3] for h in hits)
    near = 0
    if hits:
        you = [i for i, w in enumerate(words) if w in YOU]
        k = 0
        for i, *_ in hits:
            while k < len(you) and you[k] < i - NEAR:
                k += 1
            near += k < len(you) and you[k] <= i + NEAR
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text))
    marks = len(text) - letters - text.count(" ") - text.count("\n")
    weights = [h[1] for h in hits]
    return [len(hits) / n, sum(weights) / n, max(weights, default=0.0), math.log1p(len(hits)), math.log1p(len({h[2] for h in hits})), near / n,
            upper / max(letters, 1), marks / len(text), (text.count("!") + text.count("?")) / n, len(INSIDE.findall(text)) / n, hidden / n, math.log1p(n)]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` labelled training documents by a hash of doc_id; one label per document (the largest)."""
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.filter(crc_bucket(F.col("doc_id"), 4) != 2)
    n = own.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    own = own.filter(share < rows / max(n, 1))
    # The sample is bounded by ``rows``, so texts that are not in it need not move.
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies by class within each batch; hidden forms count as their plain ones."""
    for batch in small(batches):
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = Counter(w for w in (w.strip("@$*_") for w in WORD.findall(text.lower())) if w.isalpha())
            opens: Counter[str] = Counter()
            for w, n in words.items():
                for k in OPENINGS:
                    if len(w) >= k:
                        opens[w[:k] + "-"] += n
            own = {*words, *(o for o, n in opens.items() if n > 1)}  # one word alone says little about an opening
            for w in own:
                seen.setdefault(w, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["word", "clean", "bad"])


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    bad, clean = totals["bad"] or 0, totals["n"] - (totals["bad"] or 0)
    counts = rows.select("text", "toxic").mapInArrow(_words, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    sure = odds - 2.0 * F.sqrt(1.0 / (F.col("bad") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    top = counts.filter("bad >= 3").select("word", odds.alias("odds"), sure.alias("sure")).filter(F.col("sure") > MIN_ODDS)
    return {r["word"]: float(r["odds"]) for r in top.orderBy(F.desc("sure"), "word").limit(size).collect()}


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for batch in small(batches):
            x = [features(t or "", known) for t in batch.column("text").to_pylist()]
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(x, pa.list_(pa.float64()))], names=[c for c in batch.schema.names if c != "text"] + ["x"])

    return run


def featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """The rows without text and with the feature array ``x``."""
    keep = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_featured(lexicon), f"{keep}, x array<double>")


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x")).drop("x")


class Scorer:
    """Trees and an isotonic curve; without both classes, the share of label 1 for every text."""

    def __init__(self, rows: DataFrame):
        rows = materialise(rows, "toxic-rows")
        part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10))
        self.lexicon = learn_lexicon(rows.filter(part < 4))
        data = _vectors(featured(rows.filter(part >= 4), self.lexicon)).select("features", F.col("toxic").cast("double").alias("label"), part.alias("part"))
        data = materialise(data.coalesce(4), "toxic-features")
        kinds = {(r["cal"], r["label"]) for r in data.select((F.col("part") >= 7).alias("cal"), "label").distinct().collect()}
        self.trees = self.curve = None
        self.share = data.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        if len(kinds) == 4:
            self.trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=5, maxBins=32).fit(data.filter("part < 7"))
            self.curve = IsotonicRegression().fit(self._margin(data.filter("part >= 7")))

    def _margin(self, df: DataFrame) -> DataFrame:
        """The trees' raw margin as the one feature of the curve."""
        raw = self.trees.setFeaturesCol("features").transform(df)
        return raw.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("margin", "features")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score. Null and empty texts are scored as texts without words."""
        x = featured(docs.select("doc_id", "text"), self.lexicon)
        if self.trees is None:
            return x.select("doc_id", F.lit(float(self.share)).alias("score"))
        out = self.curve.transform(self._margin(_vectors(x)))
        return out.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scorer = Scorer(labelled(docs, table(spark, sf_dir, "labels")))
    return scorer.score(docs).select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
