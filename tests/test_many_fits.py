"""Rosters of fits over prepared rows: against pyspark.ml, hand counts and failures."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sigmeter.operators import many_fits as MF, models as M

NF, WIDTH = 2, 3
KEYS = ["model_family", "hpo_profile_id", "seed", "fold_id"]


@pytest.fixture(scope="module")
def members(spark):
    rng, rows = random.Random(3), []
    for group, n in (("a", 240), ("b", 160)):
        for i in range(n):
            x = [rng.gauss(1, 2) for _ in range(NF * WIDTH)]
            y = int(rng.random() < 1 / (1 + np.exp(-(x[0] - x[3] + 0.3))))
            t = dt.datetime(2024, 1, 1 + i // 20, 10, i % 20)
            rows.append((f"{group}{i}", f"T{i % 2}", str(t.date()), t, y, x, group, "train" if i < n * 3 // 4 else "eval"))
    rows += [(f"c{i}", "T0", "2024-01-01", dt.datetime(2024, 1, 1, 10, i), 1, [float(i)] * 6, "c", "train" if i < 6 else "eval") for i in range(9)]
    rows += [(f"d{i}", "T0", "2024-01-01", dt.datetime(2024, 1, 1, 10, i), 1, [float(i)] * 6, "d", "eval") for i in range(3)]
    return spark.createDataFrame(rows, "sample_id string, ticker string, trading_day string, target_timestamp timestamp_ntz, label int, features array<float>, fit_group string, fold_side string")


@pytest.fixture(scope="module")
def data(members):
    return MF.prepare(members, NF)


def test_prepared_rows_are_scaled_and_weighted_by_their_group(data):
    x = np.array([r.features for r in data.part("a", "train").select("features").collect()])
    assert np.allclose(x.reshape(-1, NF).mean(0), 0, atol=1e-6) and np.allclose(x.reshape(-1, NF).std(0), 1, atol=1e-6)
    n = data.counts["a"]
    assert sum(n.values()) == 180
    for r in data.part("a", "train").select("label", "weight").distinct().collect():
        assert r.weight == pytest.approx(180 / (2 * n[r.label]))
    assert data.stops["a"]["train_rows"] == 130 and data.stops["a"]["eval_rows"] == 50 and data.stops["a"]["reason"] == MF.STOP_REASON
    assert data.stops["c"]["reason"].startswith("insufficient") and "eval_rows" not in data.stops["c"]


def test_linear_fits_of_all_groups_equal_pyspark_ml(data):
    profiles = [M.Profile("logit", "l2", {"reg": 0.01}), M.Profile("logit", "l2_strong", {"reg": 0.1}), M.Profile("trend_linear", "k3", {"kernels": (3,)}),
                M.Profile("multi_trend_linear", "k23", {"kernels": (2, 3)})]
    units = dict(enumerate((g, p) for g in ("a", "b") for p in profiles))
    scored = MF.score_linear(data, units, MF.fit_linear(data, units, NF, WIDTH), NF, WIDTH).toPandas()
    for u, (g, p) in units.items():
        train = M.prepared(data.part(g, "train"), p, NF, WIDTH).withColumn("label", F.col("label").cast("double"))
        model = LogisticRegression(featuresCol="vec", weightCol="weight", regParam=p.params.get("reg", 0.01), maxIter=300, tol=1e-12).fit(train)
        want = model.transform(M.prepared(data.part(g, "eval"), p, NF, WIDTH)).select("sample_id", vector_to_array("probability")[1].alias("want")).toPandas()
        both = scored[scored.unit == u].merge(want, on="sample_id")
        assert len(both) == len(want) > 0 and np.abs(both.p_up - both.want).max() < 1e-4


def roster():
    names = {"logit": M.Profile("logit", "l2", {}), "trees": M.Profile("trees", "d2", {"iters": 2, "depth": 2}), "mlp": M.Profile("last_step_mlp", "h3", {"hidden": 3, "iters": 5})}
    return [{"profile": p, "seed": s, "fit_group": g, "fold_id": f"fold_{g}"} for p in names.values() for s in (1, 2) for g in "abcd"]


def test_ledger_has_every_unit_with_its_baselines_and_early_stop(spark, data):
    got = MF.run_roster(data, roster(), NF, WIDTH)
    rows = {(r.model_family, r.seed, r.fold_id): r for r in M.trial_rows(got, KEYS, spark).collect()}
    assert len(rows) == 3 * 2 * 4
    evals = data.part("a", "eval").toPandas()
    up, n = int(evals.label.sum()), len(evals)
    most = max(data.counts["a"], key=lambda c: (data.counts["a"][c], -c))
    f1_up, f1_down = up / (up + n) * 2 / 2, (n - up) / (2 * n - up) * 2 / 2
    for family in ("logit", "trees", "last_step_mlp"):
        r = rows[family, 1, "fold_a"]
        assert r.fit_status == "completed" and r.n_rows == n and 0.4 < r.roc_auc <= 1
        assert r.constant_up_macro_f1 == pytest.approx(f1_up) and r.constant_down_macro_f1 == pytest.approx(f1_down)
        assert r.majority_macro_f1 == pytest.approx(f1_up if most == 1 else f1_down) and r.delta_vs_majority == pytest.approx(r.macro_f1 - r.majority_macro_f1)
    tree = rows["trees", 2, "fold_a"]
    assert tree.early_stopping_used and tree.best_iteration >= 1 and tree.early_stopping_train_ids != tree.early_stopping_eval_ids
    assert not rows["trees", 1, "fold_c"].early_stopping_used and rows["logit", 1, "fold_a"].early_stopping_reason == "family_has_no_early_stopping"
    assert rows["logit", 1, "fold_c"].accuracy == 1.0  # one class: always that class
    assert all(rows[f, s, "fold_d"].fit_status == "failed" and rows[f, s, "fold_d"].macro_f1 is None for f in ("logit", "trees", "last_step_mlp") for s in (1, 2))


def test_embargo_takes_the_first_day_from_the_same_fit(spark, data):
    got = MF.run_roster(data, [u for u in roster() if u["profile"].family == "logit"], NF, WIDTH)
    rows = {(r.seed, r.fold_id, r.variant_id): r for r in M.embargoed(got, KEYS, spark).collect()}
    preds = got.preds.filter("seed = 1 AND fold_id = 'fold_a'").toPandas()
    first = preds.trading_day.min()
    assert rows[1, "fold_a", "no_embargo"].n_rows == len(preds) and rows[1, "fold_a", "embargo_1day"].n_rows == (preds.trading_day > first).sum()
    late = preds[preds.trading_day > first]

    def f1(y, p):
        def one(c):
            hit = ((y == c) & (p == c)).sum()
            return 2 * hit / max((y == c).sum() + (p == c).sum(), 1)
        return (one(0) + one(1)) / 2

    want = f1(late.y_true, late.y_pred) - f1(late.y_true, late.base_pred)
    assert rows[1, "fold_a", "embargo_1day"].delta_vs_dummy == pytest.approx(want)
    assert rows[1, "fold_c", "embargo_1day"].fit_status == "failed" and rows[1, "fold_c", "no_embargo"].fit_status == "completed"


def test_a_failed_fit_leaves_the_others(spark, data):
    def hook(d, group, profile, seed):
        if group == "b":
            raise RuntimeError("broken")
        return d.part(group, "eval").select(*MF.IDS, F.lit(0.9).alias("p_up"))

    got = MF.run_roster(data, roster(), NF, WIDTH, hook)
    rows = M.trial_rows(got, KEYS, spark).collect()
    assert len(rows) == 24 and {r.error for r in rows if r.fold_id == "fold_b"} == {"RuntimeError: broken"}
    assert {r.fit_status for r in rows if r.fold_id in ("fold_a", "fold_c")} == {"completed"}
