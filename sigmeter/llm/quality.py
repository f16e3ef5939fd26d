"""Quality by weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation estimates each
labeller's vote probabilities given the hidden class from the counts of vote patterns over all
documents; the posterior of a pattern is a soft label. A linear scorer over hashed features of text shape
learns from soft labels on a bounded sample and scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialise, small_batches
from .chunks import forget_tables, small
from .common import documents

FIT_ROWS = 4000  # documents that the scorer is fitted on, about
BUCKETS = 1 << 11
KEEP = 0.5
MOST_FALSE_ALARMS = 0.01
SHORT = 40  # trigrams by which the shares of a text are damped
LONG_ENOUGH = 12  # words below which shape statistics say little

# name, statistic, bad when, good when
LABELLERS = [
    ("symbols", "symbols", lambda x: x > 0.2, lambda x: x < 0.12),
    ("capitals", "capitals", lambda x: x > 0.5, lambda x: x < 0.2),
    ("few_words", "distinct", lambda x: x < 0.12, lambda x: x > 0.3),
    ("one_word", "leading", lambda x: x > 0.3, lambda x: x < 0.15),
    ("stutter", "stutter", lambda x: x > 0.3, lambda x: x < 0.05),
    ("shouting", "shouts", lambda x: x > 0.3, lambda x: x < 0.05),
    ("table", "bars", lambda x: x > 0.25, lambda x: x < 0.05),
    ("decorated", "decorated", lambda x: x > 0.3, lambda x: x < 0.1),
    ("unpunctuated", "stops", lambda x: x > 0.6, lambda x: x < 0.4),
]
SHAPE = np.full(256, ord("a"), np.uint8)
SHAPE[:128] = np.arange(128)
SHAPE[ord("a"):ord("z") + 1] = ord("a")
SHAPE[ord("A"):ord("Z") + 1] = ord("A")
SHAPE[ord("0"):ord("9") + 1] = ord("0")
SHAPE[[9, 10, 11, 12, 13]] = ord(" ")


def statistics(text: str) -> dict[str, float] | None:
    """Shape statistics of a text with a word, else None. Shares of few words are damped towards 0."""
    words = text.split()
    if not words:
        return None
    n = len(words)
    letters = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    bare = Counter(words)
    marks = letters - sum(map(str.isalnum, text))
    return {
        "symbols": marks / (letters + 30), "capitals": upper / (n + 3),
        "distinct": min(1.0, len(bare) / min(n, 400)) if n >= LONG_ENOUGH else 1.0,  # long texts repeat words by nature
        "leading": max(bare.values()) / n if n >= LONG_ENOUGH else 0.0,
        "stutter": sum(map(str.__eq__, words, words[1:])) / (n + 3),
        "shouts": sum(w.endswith("!!") for w in words) / (n + 3), "bars": bare["|"] / (n + 3),
        "decorated": sum(w[-1] in "#$%&*" for w in words) / (n + 3), "stops": sum(w[-1] in ".!?;," for w in words) / (n + 3),
    }


def votes(stats: dict[str, float]) -> str:
    """One character per labeller: b, g or - for abstain."""
    return "".join("b" if bad(stats[s]) else "g" if good(stats[s]) else "-" for _, s, bad, good in LABELLERS)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    for batch in small(batches):
        out = []
        for text in batch.column("text").to_pylist():
            stats = statistics(text or "")
            out.append(None if stats is None else votes(stats))
        keep = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.string())], names=[c for c in batch.schema.names if c != "text"] + ["votes"])


def expectation_maximisation(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Posterior probability of good for each vote pattern.

    A labeller has its own chance of each vote in each class, so one that seldom speaks and is then
    right weighs much. The first guess is a majority of those that vote, where a bad vote counts twice.
    """
    names = [p for p, _ in patterns]
    n = np.array([c for _, c in patterns], float)
    seen = np.array([[("b", "-", "g").index(v) for v in p] for p in names])
    bad, good = (seen == 0).sum(1), (seen == 2).sum(1)
    post = np.clip((good + 1.0) / (good + 2.0 * bad + 2.0), 0.05, 0.95)
    post = np.where(bad > 0, np.minimum(post, 0.3), np.maximum(post, 0.7))
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3)
        logs = np.stack([np.full(len(n), np.log(1 - prior)), np.full(len(n), np.log(prior))])
        for k, weight in enumerate((1 - post, post)):
            for j in range(seen.shape[1]):
                chance = np.bincount(seen[:, j], weights=n * weight, minlength=3) + 0.5
                chance /= chance.sum()
                if k:  # labellers are taken to be cautious: a good document seldom gets a bad vote
                    chance[0] = min(chance[0], MOST_FALSE_ALARMS)
                logs[k] += np.log(chance)[seen[:, j]]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist()))


def hashed(text: str, stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the shape trigrams of a text (each with an equal share, damped for short texts) and of its discretised statistics."""
    shape = SHAPE[np.frombuffer(f" {text} ".encode(), np.uint8)].astype(np.uint32)
    grams = shape[:-2] | (shape[1:-1] << np.uint32(8)) | (shape[2:] << np.uint32(16))
    grams = ((grams * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(BUCKETS)
    extra = [zlib.crc32(f"{k}={min(int(v * 10), 10)}".encode()) % BUCKETS for k, v in stats.items()]
    return grams, np.array(extra)


def _vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 256) for b in small(batches) for i in range(0, len(b), 256)):  # dense rows are large
        out = []
        for text in batch.column("text").to_pylist():
            grams, extra = hashed(text, statistics(text))
            v = np.bincount(grams, minlength=BUCKETS) / (len(grams) + SHORT)
            np.add.at(v, extra, 1.0)
            out.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(out, pa.list_(pa.float64()))], names=["good", "x"])


class Scorer:
    """Soft labels from all documents, a linear scorer from a sample of them."""

    def __init__(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        voted = docs.select("text", F.xxhash64("text").alias("slot")).mapInArrow(_vote, "slot long, votes string").filter("votes IS NOT NULL")
        voted = materialise(voted, "quality-votes")
        patterns = sorted((r["votes"], r["count"]) for r in voted.groupBy("votes").count().collect())  # 3 to the number of labellers at most
        self.posterior: dict[str, float] = {}
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        if not patterns:
            return
        self.posterior = expectation_maximisation(patterns)
        total = sum(n for _, n in patterns)
        # Patterns are thinned to a bounded sample, rare ones less.
        share = {p: min(1.0, FIT_ROWS / len(patterns) / n + 0.5 * FIT_ROWS / total) for p, n in patterns}
        facts = docs.sparkSession.createDataFrame([(p, share[p], self.posterior[p]) for p, _ in patterns], "votes string, share double, good double")
        chance = F.pmod("slot", F.lit(1 << 30)) / float(1 << 30)
        picked = voted.join(F.broadcast(facts), "votes").filter(chance < F.col("share")).groupBy("slot").agg(F.first("good").alias("good"))
        picked = materialise(picked, "quality-picked")  # about FIT_ROWS rows whatever the input
        sample = docs.select("text", F.xxhash64("text").alias("slot")).join(F.broadcast(picked), "slot")
        sample = sample.groupBy("slot").agg(F.first("text").alias("text"), F.first("good").alias("good")).select("text", "good")  # a text once
        data = materialise(sample.repartition(8).mapInArrow(_vector, "good double, x array<double>"), "quality-fit")
        both = data.select(F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")),
                                             F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight")))).alias("y"), array_to_vector("x").alias("features"))
        both = both.select("y.label", "y.weight", "features").filter("weight > 1e-6")
        fit = LogisticRegression(weightCol="weight", regParam=2e-3, maxIter=40).fit(both)
        self.weights, self.bias = fit.coefficients.toArray(), float(fit.intercept)

    def score(self, docs: DataFrame, with_votes: bool = False) -> DataFrame:
        """All columns of ``docs`` and ``quality``: chance of good; 0 for null, empty and wordless texts. Votes on request."""
        weights, bias = self.weights, self.bias
        added = ["quality", "votes"][:1 + with_votes]
        if set(added) & set(docs.columns):
            raise ValueError(f"columns {added} must be free")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_tables()
            for batch in small(batches):
                out, voted = [], []
                for text in batch.column("text").to_pylist():
                    stats = statistics(text or "")
                    voted.append(None if stats is None else votes(stats))
                    if stats is None:
                        out.append(0.0)
                    else:
                        grams, extra = hashed(text, stats)
                        out.append(float(1 / (1 + np.exp(-np.clip(bias + weights[grams].sum() / (len(grams) + SHORT) + weights[extra].sum(), -50, 50)))))
                more = [pa.array(out, pa.float64()), pa.array(voted, pa.string())][:len(added)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *added])

        kinds = [T.StructField("quality", T.DoubleType()), T.StructField("votes", T.StringType())][:len(added)]
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds]))


def rejecting(docs: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, with their columns as they were."""
    name = "quality"
    slim = docs if name not in docs.columns else docs.withColumnRenamed(name, "_own_quality")
    kept = Scorer(slim).score(slim).filter(F.col(name) >= KEEP).drop(name)
    return kept.select(*([c if c != name else F.col("_own_quality").alias(name) for c in docs.columns]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: votes, posterior of its pattern, score of the linear model and whether it is kept."""
    docs = documents(spark, sf_dir)
    scorer = Scorer(docs)
    told = spark.createDataFrame(list(scorer.posterior.items()), "votes string, posterior double")
    scored = scorer.score(docs.select("doc_id", "text"), with_votes=True).drop("text")
    return scored.join(F.broadcast(told), "votes", "left").select("doc_id", "votes", "posterior", F.col("quality").alias("score"), (F.col("quality") >= KEEP).alias("kept"))
