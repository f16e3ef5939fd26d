"""Rosters of fits over shared rows: rows prepared once per group, linear families fitted together.

A group is what a fit sees (a fold, a period, an arm of a fold). ``prepare`` takes feature statistics, class
weights and the early-stop tail of all groups in one job each and writes the scaled rows once.
Logistic units of every group are then fitted by Newton steps on Gram sums keyed by unit: one pass over
the rows per step for all units, whatever their number. Trees and perceptrons are ``pyspark.ml`` fits on the
same prepared rows, side by side in a pool.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, scratch_path, ship_package
from .baselines import stratified_dummy
from .folds import early_stop_tail
from .integrity import fingerprint
from .models import Profile, Trials, balanced_copies, feature_statistics, n_inputs, prepared

LINEAR = ("logit", "trend_linear", "multi_trend_linear")
TREES = ("trees", "last_step_trees")
STEPS = 30
TOLERANCE = 1e-8
POOL = 8
STOP_REASON = "configured_inner_train_subsplit"


@dataclass
class Prepared:
    """Scaled rows by (fit_group, fold_side), and per group its class counts and early-stop record."""

    rows: DataFrame
    counts: dict[str, dict[int, int]]
    stops: dict[str, dict] = field(default_factory=dict)

    def part(self, group: str, side: str) -> DataFrame:
        return self.rows.filter((F.col("fit_group") == group) & (F.col("fold_side") == side))


def prepare(members: DataFrame, n_features: int, fraction: float = 0.2, min_eval: int = 50, min_train: int = 50) -> Prepared:
    """``members``: fit_group, fold_side ('train' or not), ids, label and features; groups are a configured roster.

    Scaling and weights come from a group's train rows only. Groups without train rows keep their rows unscaled;
    their fits fail and are recorded.
    """
    spark = members.sparkSession
    ship_package(spark)
    train = members.filter("fold_side = 'train'")
    facts = feature_statistics(train, n_features, ["fit_group"])
    scale = facts.groupBy("fit_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_index", "mean", "std"))), lambda s: F.struct(s["mean"].alias("m"), s["std"].alias("s"))).alias("_scale"))
    per_class = train.groupBy("fit_group", "label").agg(F.count("*").alias("n")).collect()  # two rows a group
    counts: dict[str, dict[int, int]] = {}
    for r in per_class:
        counts.setdefault(r["fit_group"], {})[int(r["label"])] = r["n"]
    weights = spark.createDataFrame([(g, c, sum(n.values()) / (2 * k)) for g, n in counts.items() for c, k in n.items()] or [("", 0, 0.0)], "fit_group string, _l int, weight double")
    tail = early_stop_tail(train, ["fit_group"], fraction, min_eval, min_train).withColumnRenamed("reason", "stop_reason")
    rest = members.filter("fold_side <> 'train'").withColumns({"is_stop": F.lit(False), "stop_reason": F.lit(None).cast("string")})
    x = tail.unionByName(rest, allowMissingColumns=True).join(F.broadcast(scale), "fit_group", "left")
    cell = lambda v, i: (v.cast("double") - F.get("_scale", i % n_features)["m"]) / F.get("_scale", i % n_features)["s"]
    x = x.withColumn("features", F.coalesce(F.transform("features", cell), F.transform("features", lambda v: v.cast("double")))).drop("_scale")
    x = x.join(F.broadcast(weights), (weights["fit_group"] == x["fit_group"]) & (F.col("label") == F.col("_l")), "left").drop(weights["fit_group"]).drop("_l")
    path = scratch_path(spark, "prepared")
    keep = ["sample_id", "ticker", "trading_day", "target_timestamp", "label", "weight", "is_stop", "stop_reason", "features", "fit_group", "fold_side"]
    x.select(*keep).write.partitionBy("fit_group", "fold_side").parquet(path)
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in x.select(*keep).dtypes)).parquet(path)
    out = Prepared(rows, counts)
    marks = fingerprint(rows.filter("fold_side = 'train'"), ["fit_group", "is_stop", "stop_reason"], F.col("sample_id")).collect()  # two rows a group
    for r in marks:
        s = out.stops.setdefault(r["fit_group"], {"reason": r["stop_reason"]})
        side = "eval" if r["is_stop"] else "train"
        s |= {f"{side}_rows": r["n_ids"], f"{side}_ids": f"{r['hash_sum']}-{r['hash_xor']}"}
    return out


def input_map(profile: Profile, n_features: int, width: int) -> np.ndarray:
    """Inputs of a linear family as a matrix on the time-major features: identity, or trend and residual of each kernel."""
    d = n_features * width
    if profile.family == "logit":
        return np.eye(d)
    parts = []
    for kernel in profile.params.get("kernels", (3,)):
        trend = np.zeros((d, d))
        left = (kernel - 1) // 2
        for i in range(d):
            t, f = divmod(i, n_features)
            for off in range(-left, kernel - left):
                trend[min(max(t + off, 0), width - 1) * n_features + f, i] += 1 / kernel
        parts += [trend, np.eye(d) - trend]
    return np.concatenate(parts, 1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("features")
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _gram(state):
    """Weight, loss, gradient and Hessian sums of every unit over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, units = state.value  # units: number -> (group, map number, coefficients)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = _vectors(batch), np.asarray(batch.column("label")).astype(float), np.asarray(batch.column("weight"))
            groups = np.asarray(batch.column("fit_group").to_pylist(), object)
            inputs: dict[tuple, np.ndarray] = {}
            for u, (group, m, beta) in units.items():
                at = np.flatnonzero(groups == group)
                if not len(at):
                    continue
                if (group, m) not in inputs:
                    inputs[group, m] = np.concatenate([np.ones((len(at), 1)), x[at] @ maps[m]], 1)
                z, wu, yu = inputs[group, m], w[at], y[at]
                score = z @ beta
                p = _logistic(score)
                loss = wu @ (np.logaddexp(0, score) - yu * score)
                part = np.concatenate([[wu.sum(), loss, len(at)], z.T @ (wu * (p - yu)), (z.T @ (z * (wu * p * (1 - p))[:, None])).ravel()])
                sums[u] = sums[u] + part if u in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["unit", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for u, s in zip(batch.column("unit").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(s)
            total[u] = total[u] + part if u in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["unit", "sums"])


def summed(parts: DataFrame, n_tasks: int) -> dict[int, np.ndarray]:
    """Sums of a task's arrays by unit in two levels; the driver gets at most sqrt(tasks) rows a unit."""
    slots = max(1, int(np.sqrt(n_tasks)))
    if n_tasks > 64:
        parts = parts.withColumn("_s", F.spark_partition_id() % slots).repartition(slots, "_s").drop("_s").mapInArrow(_added, "unit int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        s = np.frombuffer(bytes(r["sums"]))
        out[r["unit"]] = out[r["unit"]] + s if r["unit"] in out else s
    return out


@dataclass
class Newton:
    """A ridge logistic fit: the penalty is on coefficients of standardised inputs, the intercept is free."""

    reg: float
    beta: np.ndarray
    done: bool = False
    best: float = np.inf
    penalty: np.ndarray | None = None
    step: np.ndarray | None = None

    def advance(self, sums: np.ndarray) -> None:
        p = len(self.beta)
        total, loss, n = sums[:3]
        grad, hess = sums[3:3 + p] / total, sums[3 + p:].reshape(p, p) / total
        if self.penalty is None:  # all coefficients are 0: the Hessian holds a quarter of the second moments
            mean = 4 * hess[0]
            self.penalty = np.maximum(4 * np.diag(hess) - mean**2, 0) * n / max(n - 1, 1) * self.reg
            self.penalty[0] = 0
        value = loss / total + 0.5 * self.penalty @ self.beta**2
        if value > self.best + 1e-12 and self.step is not None:
            self.step = self.step / 2
            self.beta = self.beta - self.step
        else:
            self.best = value
            full = hess + np.diag(self.penalty) + 1e-12 * np.eye(p)
            self.step = -np.linalg.lstsq(full, grad + self.penalty * self.beta, rcond=None)[0]
            self.beta = self.beta + self.step
        self.done = bool(np.abs(self.step).max() < TOLERANCE)


def fit_linear(data: Prepared, units: dict[int, tuple[str, Profile]], n_features: int, width: int) -> dict[int, np.ndarray]:
    """Coefficients (intercept first) of every unit: number -> (fit_group, profile). One job per Newton step."""
    context = data.rows.sparkSession.sparkContext
    shapes = sorted({(p.family, tuple(p.params.get("kernels", (3,)))) for _, p in units.values()})
    maps = [input_map(Profile(f, "", {"kernels": k}), n_features, width) for f, k in shapes]
    place = {u: shapes.index((p.family, tuple(p.params.get("kernels", (3,))))) for u, (_, p) in units.items()}
    runs = {u: Newton(p.params.get("reg", 0.01), np.zeros(maps[place[u]].shape[1] + 1)) for u, (_, p) in units.items()}
    out: dict[int, np.ndarray] = {}
    for u, (g, _) in units.items():
        have = data.counts.get(g, {})
        if len(have) < 2:  # one class: always that class
            runs[u].done = True
            runs[u].beta[0] = np.inf if 1 in have else -np.inf
    rows = data.rows.filter((F.col("fold_side") == "train") & F.col("fit_group").isin(sorted({g for g, _ in units.values()}))).select("fit_group", "label", "weight", "features")
    n_tasks = rows.rdd.getNumPartitions()
    for _ in range(STEPS):
        open_ = {u: (units[u][0], place[u], r.beta) for u, r in runs.items() if not r.done}
        if not open_:
            break
        state = context.broadcast((maps, open_))
        for u, s in summed(rows.mapInArrow(_gram(state), "unit int, sums binary"), n_tasks).items():
            runs[u].advance(s)
    for u, r in runs.items():
        out[u] = r.beta
    return out


def _scored(state, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, units = state.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            groups = np.asarray(batch.column("fit_group").to_pylist(), object)
            for u, (group, m, beta) in units.items():
                at = np.flatnonzero(groups == group)
                if len(at):
                    p = _logistic(beta[0] + x[at] @ (maps[m] @ beta[1:])) if np.isfinite(beta[0]) else np.full(len(at), float(beta[0] > 0))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), u), pa.int32())] + [batch.column(c).take(take) for c in names] + [pa.array(p)], names=["unit", *names, "p_up"])

    return run


IDS = ["sample_id", "ticker", "trading_day", "target_timestamp", "label"]


def score_linear(data: Prepared, units: dict[int, tuple[str, Profile]], fits: dict[int, np.ndarray], n_features: int, width: int) -> DataFrame:
    """(unit, ids, label, p_up) of every evaluation row under every unit of its group, in one pass."""
    shapes = sorted({(p.family, tuple(p.params.get("kernels", (3,)))) for _, p in units.values()})
    maps = [input_map(Profile(f, "", {"kernels": k}), n_features, width) for f, k in shapes]
    told = {u: (g, shapes.index((p.family, tuple(p.params.get("kernels", (3,))))), fits[u]) for u, (g, p) in units.items()}
    rows = data.rows.filter((F.col("fold_side") != "train") & F.col("fit_group").isin(sorted({g for g, _ in units.values()}))).select("fit_group", *IDS, "features")
    kinds = dict(rows.dtypes)
    state = rows.sparkSession.sparkContext.broadcast((maps, told))
    return rows.mapInArrow(_scored(state, IDS), "unit int, " + ", ".join(f"{c} {kinds[c]}" for c in IDS) + ", p_up double")


def fit_prepared(data: Prepared, group: str, profile: Profile, seed: int, n_features: int, width: int) -> tuple[DataFrame, int | None]:
    """Predictions of a tree or perceptron family on a group's prepared rows, and the trees kept."""
    t = prepared(data.part(group, "train"), profile, n_features, width).withColumn("label", F.col("label").cast("double"))
    p = profile.params
    if profile.family in TREES:
        est = GBTClassifier(featuresCol="vec", weightCol="weight", maxIter=p.get("iters", 5), maxDepth=p.get("depth", 3), seed=seed)
        if data.stops[group].get("eval_rows"):  # a tail too short or of one class means no early stop
            est.setValidationIndicatorCol("is_stop")
    elif profile.family == "last_step_mlp":
        t = balanced_copies(t, seed)
        est = MultilayerPerceptronClassifier(featuresCol="vec", layers=[n_inputs(profile, n_features, width), p.get("hidden", 8), 2], maxIter=p.get("iters", 30), seed=seed)
    else:
        raise ValueError(f"unknown family {profile.family!r}")
    model = est.fit(t)
    out = model.transform(prepared(data.part(group, "eval"), profile, n_features, width))
    return out.select(*IDS, vector_to_array("probability")[1].alias("p_up")), model.getNumTrees if profile.family in TREES else None


def run_roster(data: Prepared, units: list[dict], n_features: int, width: int, hook: Callable | None = None) -> Trials:
    """Predictions of every unit (profile, seed, fit_group and its labels); failed units are recorded.

    A linear fit has no random part, so one fit serves all seeds of a unit. ``hook`` (data, group, profile, seed)
    replaces every fit; it returns ids, label and p_up.
    """
    spark = data.rows.sparkSession
    failures = [(u, "ValueError: no fit rows to scale by") for u in units if not data.counts.get(u["fit_group"])]
    live = [u for u in units if data.counts.get(u["fit_group"])]
    linear = [u for u in live if u["profile"].family in LINEAR and hook is None]
    parts: list[DataFrame] = []
    records: list[tuple] = []
    if linear:
        shared = sorted({(u["fit_group"], u["profile"].family, u["profile"].profile_id) for u in linear})
        of = {s: i for i, s in enumerate(shared)}
        profiles = {(u["profile"].family, u["profile"].profile_id): u["profile"] for u in linear}
        numbered = {i: (g, profiles[f, i_d]) for (g, f, i_d), i in of.items()}
        scored = score_linear(data, numbered, fit_linear(data, numbered, n_features, width), n_features, width)
        names = sorted({k for u in linear for k in labels_of(u)})
        told = [(of[u["fit_group"], u["profile"].family, u["profile"].profile_id], u["fit_group"], u["seed"], u["profile"].family, u["profile"].profile_id, *[u.get(k) for k in names]) for u in linear]
        roster = spark.createDataFrame(told, "unit int, fit_group string, seed int, model_family string, hpo_profile_id string" + "".join(f", {k} string" for k in names))
        parts.append(scored.join(F.broadcast(roster), "unit").drop("unit"))

    def one(u: dict) -> tuple[DataFrame, int | None] | str:
        try:
            got = hook(data, u["fit_group"], u["profile"], u["seed"]) if hook else fit_prepared(data, u["fit_group"], u["profile"], u["seed"], n_features, width)
        except Exception as e:  # recorded with the unit
            return f"{type(e).__name__}: {e}"[:500]
        return got if isinstance(got, tuple) else (got, None)

    other = [u for u in live if hook or u["profile"].family not in LINEAR]
    with ThreadPoolExecutor(POOL) as pool:
        for u, got in zip(other, pool.map(one, other)):
            if isinstance(got, str):
                failures.append((u, got))
                continue
            named = {k: F.lit(v) for k, v in labels_of(u).items()} | {"fit_group": F.lit(u["fit_group"]), "seed": F.lit(u["seed"]), "model_family": F.lit(u["profile"].family), "hpo_profile_id": F.lit(u["profile"].profile_id)}
            parts.append(got[0].select(*IDS, "p_up").withColumns(named))
            if got[1] is not None:
                records.append((u["fit_group"], u["seed"], u["profile"].family, u["profile"].profile_id, got[1]))
    if not parts:
        return Trials(None, failures)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    priors = spark.createDataFrame([(g, n.get(1, 0) / sum(n.values())) for g, n in data.counts.items()], "fit_group string, prior double")
    out = out.withColumns({"y_true": F.col("label").cast("int"), "y_pred": F.when(F.col("p_up") >= 0.5, 1).otherwise(0)}).drop("label")
    out = out.join(F.broadcast(priors), "fit_group").withColumn("base_pred", stratified_dummy(F.col("prior"), F.col("seed"), F.col("sample_id")))
    # Written, so that no reader of the predictions repeats a fit's scoring.
    return Trials(materialise(out, "roster-predictions"), failures, early_stops(data, units, records))


def labels_of(unit: dict) -> dict:
    return {k: v for k, v in unit.items() if k not in ("profile", "seed", "fit_group")}


def early_stops(data: Prepared, units: list[dict], records: list[tuple]) -> DataFrame:
    """Early-stop record of each unit: whether a tail was used, why not, which rows it had, and the trees kept."""
    kept = {r[:4]: r[4] for r in records}
    names = sorted({k for u in units for k in labels_of(u)})
    rows = []
    for u in units:
        g, p, s = u["fit_group"], u["profile"], data.stops.get(u["fit_group"], {})
        trees = p.family in TREES
        rows.append((*[labels_of(u).get(k) for k in names], u["seed"], p.family, p.profile_id, bool(trees and s.get("eval_rows")), s.get("reason") if trees else "family_has_no_early_stopping",
                     s.get("train_ids") if trees else None, s.get("eval_ids") if trees else None, kept.get((g, u["seed"], p.family, p.profile_id))))
    return data.rows.sparkSession.createDataFrame(rows, "".join(f"{k} string, " for k in names) + "seed int, model_family string, hpo_profile_id string, early_stopping_used boolean, "
                                                  "early_stopping_reason string, early_stopping_train_ids string, early_stopping_eval_ids string, best_iteration int")
