"""Model families on ``pyspark.ml`` over window rows (one vector per sample).

Every fit and transform is a distributed job on a materialised window table. The runs at the
end are loops over a configured handful of (profile, fold, seed) units; independent units are
submitted side by side so that small fits overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import confusion as C
from ..functions.scalar import hash01, ratio
from .baselines import majority, stratified_dummy
from .folds import early_stop_tail
from .ranks import roc_auc
from .windows import last_bar, moving_average

CONCURRENT_FITS = 4


@dataclass(frozen=True)
class Profile:
    family: str
    profile_id: str
    params: dict = field(default_factory=dict)


def class_weights(train: DataFrame, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    """n / (2 n_c) per class: one small aggregate."""
    keys = keys or []
    per = train.groupBy(*keys, label).agg(F.count("*").alias("n_class"))
    tot = per.groupBy(*keys).agg(F.sum("n_class").alias("n_all"))
    j = per.join(tot, keys) if keys else per.crossJoin(tot)  # one row
    return j.select(*keys, label, ratio("n_all", 2 * F.col("n_class")).alias("weight"))


def feature_statistics(train: DataFrame, n_features: int, keys: list[str] | None = None) -> DataFrame:
    """Mean and population std per feature over fit rows and time; a std below 1e-6 counts as 1."""
    keys = keys or []
    x = train.select(*keys, F.posexplode("features").alias("_i", "_v"))
    g = x.groupBy(*keys, (F.col("_i") % n_features).alias("feature_index")).agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("_s"), F.count("*").alias("n_cells"))
    return g.select(*keys, "feature_index", "mean", F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s")).alias("std"), "n_cells")


def trend_and_residual(features: Column, n_features: int, width: int, kernels: list[int]) -> Column:
    """Moving-average trend and residual of every kernel, concatenated: a linear model on these
    is the trend head plus the residual head."""
    parts = []
    for k in kernels:
        trend = moving_average(features, n_features, width, k)
        parts += [trend, F.zip_with(features, trend, lambda x, t: x.cast("double") - t)]
    return F.concat(*parts)


def inputs_of(profile: Profile, n_features: int, width: int) -> Column:
    x = F.col("features")
    if profile.family in ("trend_linear", "multi_trend_linear"):
        return trend_and_residual(x, n_features, width, list(profile.params.get("kernels", (3,))))
    if profile.family in ("last_step_mlp", "last_step_trees"):
        return F.transform(last_bar(x, n_features), lambda v: v.cast("double"))
    return F.transform(x, lambda v: v.cast("double"))


def n_inputs(profile: Profile, n_features: int, width: int) -> int:
    if profile.family in ("trend_linear", "multi_trend_linear"):
        return 2 * n_features * width * len(profile.params.get("kernels", (3,)))
    return n_features if profile.family in ("last_step_mlp", "last_step_trees") else n_features * width


def prepared(rows: DataFrame, profile: Profile, n_features: int, width: int) -> DataFrame:
    return rows.withColumn("vec", array_to_vector(inputs_of(profile, n_features, width)))


@dataclass(frozen=True)
class Scaling:
    """Mean and std per feature of the fit rows, the same at every time step."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def apply(self, rows: DataFrame) -> DataFrame:
        mean, std = F.array(*map(F.lit, self.mean)), F.array(*map(F.lit, self.std))
        at = lambda a, i: F.get(a, i % len(self.mean))
        return rows.withColumn("features", F.transform("features", lambda v, i: (v.cast("double") - at(mean, i)) / at(std, i)))


@dataclass(frozen=True)
class Fitted:
    scaling: Scaling
    model: object


def scaling_of(train: DataFrame, n_features: int) -> Scaling:
    rows = sorted(feature_statistics(train, n_features).collect(), key=lambda r: r["feature_index"])  # one row per feature
    if len(rows) != n_features:
        raise ValueError("no fit rows to scale by")
    return Scaling(tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows))


def balanced_copies(train: DataFrame, seed: int) -> DataFrame:
    """Rows repeated in proportion to ``weight``, for an estimator without weights; fractions by a keyed hash."""
    least = train.agg(F.min("weight").alias("_w"))
    n = F.col("weight") / F.col("_w")
    copies = F.floor(n + hash01("copies", F.lit(seed), F.col("sample_id"))).cast("int")
    return train.crossJoin(F.broadcast(least)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).drop("_copy", "_w")


def fit(train: DataFrame, profile: Profile, seed: int, n_features: int, width: int) -> Fitted:
    """Fit one family on weighted train rows; scaling is fitted on these rows only."""
    scaling = scaling_of(train, n_features)
    w = class_weights(train).withColumnRenamed("label", "_l")
    t = scaling.apply(train).join(F.broadcast(w), F.col("label") == F.col("_l")).drop("_l")  # two rows
    t = prepared(t, profile, n_features, width).withColumn("label", F.col("label").cast("double"))
    p = profile.params
    if profile.family in ("logit", "trend_linear", "multi_trend_linear"):
        est = LogisticRegression(featuresCol="vec", weightCol="weight", regParam=p.get("reg", 0.01), maxIter=p.get("iters", 20))
    elif profile.family in ("trees", "last_step_trees"):
        tail = early_stop_tail(t.withColumn("label", F.col("label").cast("int")).withColumn("_g", F.lit(0)), ["_g"],
                               0.2, p.get("min_eval", 50), p.get("min_train", 50))
        t = tail.withColumn("label", F.col("label").cast("double"))
        est = GBTClassifier(featuresCol="vec", weightCol="weight", maxIter=p.get("iters", 5), maxDepth=p.get("depth", 3), seed=seed)
        if t.filter("is_stop").limit(1).count():  # a tail too short or of one class means no early stop
            est.setValidationIndicatorCol("is_stop")
    elif profile.family == "last_step_mlp":
        t = balanced_copies(t, seed)
        est = MultilayerPerceptronClassifier(featuresCol="vec", layers=[n_inputs(profile, n_features, width), p.get("hidden", 8), 2],
                                             maxIter=p.get("iters", 30), seed=seed)
    else:
        raise ValueError(f"unknown family {profile.family!r}")
    return Fitted(scaling, est.fit(t))


def predict(fitted: Fitted, rows: DataFrame, profile: Profile, n_features: int, width: int) -> DataFrame:
    """Prediction rows: identity columns, y_true, p_up and y_pred."""
    out = fitted.model.transform(prepared(fitted.scaling.apply(rows), profile, n_features, width).drop("features"))
    p_up = vector_to_array("probability")[1]
    return out.select("sample_id", "ticker", "trading_day", "target_timestamp", F.col("label").cast("int").alias("y_true"),
                      p_up.alias("p_up"), F.when(p_up >= 0.5, 1).otherwise(0).alias("y_pred"))


FitFunction = Callable[[DataFrame, DataFrame, Profile, int], DataFrame]


def fit_and_score(n_features: int, width: int) -> FitFunction:
    """The default fit hook: (train, eval, profile, seed) -> prediction rows."""
    def run(train: DataFrame, evals: DataFrame, profile: Profile, seed: int) -> DataFrame:
        return predict(fit(train, profile, seed, n_features, width), evals, profile, n_features, width)
    return run


def with_dummy(preds: DataFrame, train: DataFrame, seed: int) -> DataFrame:
    """Same-row stratified dummy from the unit's own train prior (one row)."""
    prior = train.agg(F.avg("label").alias("prior"))
    x = preds.crossJoin(F.broadcast(prior)).withColumn("seed", F.lit(seed))
    return x.withColumn("base_pred", stratified_dummy(F.col("prior"), F.col("seed"), F.col("sample_id")))


@dataclass(frozen=True)
class Trials:
    """What a roster of units gave: predictions of those that were fitted, (unit, error) of those that failed, and early-stop records."""

    preds: DataFrame | None
    failures: list[tuple[dict, str]]
    stops: DataFrame | None = None


def run_trials(units: list[dict], rows_of: Callable[[dict], tuple[DataFrame, DataFrame]], hook: FitFunction) -> Trials:
    """Predictions of every unit (profile, seed and its labels), unioned; a unit that fails is recorded and the others go on.

    ``rows_of`` gives the unit's train and evaluation rows. Units are a configured roster.
    """
    def one(u: dict) -> DataFrame | str:
        try:
            train, evals = rows_of(u)
            p = with_dummy(hook(train, evals, u["profile"], u["seed"]), train, u["seed"])
        except Exception as e:  # recorded with the unit
            return f"{type(e).__name__}: {e}"[:500]
        tags = {k: F.lit(v) for k, v in u.items() if k not in ("profile", "seed")}
        return p.withColumns({**tags, "model_family": F.lit(u["profile"].family), "hpo_profile_id": F.lit(u["profile"].profile_id)})

    with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        parts = list(pool.map(one, units))
    failures = [(u, p) for u, p in zip(units, parts) if isinstance(p, str)]
    out = None
    for p in parts:
        if not isinstance(p, str):
            out = p if out is None else out.unionByName(p)
    return Trials(out, failures)


def run_units(units: list[dict], rows_of: Callable[[dict], tuple[DataFrame, DataFrame]], hook: FitFunction) -> DataFrame:
    """Predictions of every unit; raises where one failed, for callers that need all of them."""
    got = run_trials(units, rows_of, hook)
    if got.failures:
        raise RuntimeError("; ".join(f"{u['profile'].family} {u['profile'].profile_id} seed {u['seed']}: {e}" for u, e in got.failures))
    return got.preds


def failures_of(spark: SparkSession, failures: list[tuple[dict, str]], keys: list[str], like: DataFrame | None = None) -> DataFrame:
    """Ledger rows of failed units: status failed, the error, and null metrics."""
    def value(u: dict, k: str):
        return {"model_family": u["profile"].family, "hpo_profile_id": u["profile"].profile_id}.get(k, u.get(k))

    kinds = {k: "int" if k == "seed" else "string" for k in keys}
    rows = spark.createDataFrame([tuple(value(u, k) for k in keys) + ("failed", e) for u, e in failures],
                                 ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", fit_status string, error string")
    return rows if like is None else rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in like.dtypes])


def trial_rows(trials: Trials, keys: list[str], spark: SparkSession) -> DataFrame:
    """The ledger of a roster: completed units with their metrics, failed ones with their error."""
    if trials.preds is None:
        return failures_of(spark, trials.failures, keys)
    done = ledger_of(trials.preds, keys).withColumn("error", F.lit(None).cast("string"))
    if trials.stops is not None:
        on = [c for c in trials.stops.columns if c in keys]
        done = done.join(F.broadcast(trials.stops), on, "left")  # a row for each unit of the roster
    return done.unionByName(failures_of(spark, trials.failures, keys, done)) if trials.failures else done


def embargoed(trials: Trials, keys: list[str], spark: SparkSession) -> DataFrame:
    """Ledger rows of one scoring with (``no_embargo``) and without (``embargo_1day``) each unit's first evaluation day.

    A unit's counts per day are taken once; the first day's are subtracted. A unit with one day has a failed variant.
    """
    if trials.preds is None:
        return failures_of(spark, trials.failures, keys).withColumn("variant_id", F.lit("no_embargo"))
    days = trials.preds.groupBy(*keys, "ticker", "trading_day").agg(*C.row_sums())
    whole = Window.partitionBy(*keys)  # days x tickers of a unit
    days = days.withColumn("_first", F.col("trading_day") == F.min("trading_day").over(whole))
    variants = F.array_compact(F.array(F.lit("no_embargo"), F.when(~F.col("_first"), "embargo_1day")))
    t = days.withColumn("variant_id", F.explode(variants)).groupBy(*keys, "variant_id", "ticker").agg(*C.resum())
    g = t.groupBy(*keys, "variant_id").agg(F.count_if(C.delta_f1() > 0).alias("positive_ticker_count"), *C.resum())
    both = days.select(*keys).distinct().withColumn("variant_id", F.explode(F.array(F.lit("no_embargo"), F.lit("embargo_1day"))))
    out = both.join(g, [*keys, "variant_id"], "left").select(
        *keys, "variant_id", F.when(F.col("n") > 0, "completed").otherwise("failed").alias("fit_status"), F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1"),
        C.base_f1().alias("dummy_macro_f1"), C.delta_f1().alias("delta_vs_dummy"), "positive_ticker_count", F.when(F.col("n").isNull(), "no evaluation day is left").alias("error"))
    return out.unionByName(failures_of(spark, trials.failures, keys, out)) if trials.failures else out


def ledger_of(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Trial ledger rows from prediction rows: one count aggregate, and the ROC-AUC from counts per score.

    With the unit's train ``prior`` beside the rows, the four same-row baselines are scored on the same counts.
    """
    known = "prior" in preds.columns
    t = preds.groupBy(*keys, "ticker").agg(*C.row_sums(), *([F.max("prior").alias("prior")] if known else []))
    g = t.groupBy(*keys).agg(F.count_if(C.delta_f1() > 0).alias("positive_ticker_count"), *C.resum(), *([F.max("prior").alias("prior")] if known else []))
    cols = [F.col("n").alias("n_rows"), C.macro_f1().alias("macro_f1"),
            C.balanced_accuracy().alias("balanced_accuracy"), C.accuracy().alias("accuracy"), C.mcc().alias("mcc"),
            C.base_f1().alias("dummy_macro_f1"), C.delta_f1().alias("delta_vs_dummy"), F.col("positive_ticker_count")]
    if known:
        most = C.constant_f1(majority(F.col("prior")))
        cols += [most.alias("majority_macro_f1"), (C.macro_f1() - most).alias("delta_vs_majority"),
                 C.constant_f1(1).alias("constant_up_macro_f1"), C.constant_f1(0).alias("constant_down_macro_f1")]
    out = g.select(*keys, F.lit("completed").alias("fit_status"), *cols)
    return out.join(roc_auc(preds, keys), keys, "left")
