"""Ranks with odd groups and file names, real trial failures, resumed runs, exact numbers, bounded splits."""

from __future__ import annotations

import os
import random
import re
import shutil
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigmeter.operators import models as M, ranks as R, readouts as RO, resample as RS, selective as SEL, textqa as TX
from sigmeter.plans import runs


def test_ranks_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5)], "g string, v int")
    got = sorted((str(r["g"]), r["v"], r["rk"], r["group_n"]) for r in R.group_rank(df, ["g"], [F.col("v")]).collect())
    assert got == [("None", 1, 1, 2), ("None", 3, 2, 2), ("a", 2, 1, 2), ("a", 5, 2, 2)]


def test_file_numbers_order_beyond_five_digits(spark):
    names = [f"part-{n:05d}-x.snappy.parquet" for n in (99999, 100000, 3, 1000000)]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r["f"] for r in df.orderBy(R.file_number(F.col("f"))).collect()] == [names[2], names[0], names[1], names[3]]


def test_auc_from_counts_matches_pairs(spark):
    rng = random.Random(3)
    rows = [(g, rng.random() < 0.4, round(rng.random(), 1), str(i)) for i, g in enumerate([None, "a", "b"] * 60)]
    df = spark.createDataFrame([(g, int(y), s, i) for g, y, s, i in rows], "g string, y_true int, p_up double, sample_id string")
    for r in R.roc_auc(df, ["g"]).collect():
        pos, neg = ([s for g, y, s, _ in rows if g == r["g"] and y == want] for want in (True, False))
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert r["roc_auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def window_rows(spark, n=40):
    rng = random.Random(1)
    rows = [(f"s{i}", "t", f"2024-01-{10 + i % 10:02d}", None, i % 2, [float(i % 2) + rng.random() for _ in range(4)]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, ticker string, trading_day string, target_timestamp timestamp_ntz, label int, features array<float>")


def fake(train, evals, profile, seed):
    if profile.profile_id == "bad":
        raise ValueError("no convergence")
    return evals.select("sample_id", "ticker", "trading_day", "target_timestamp", F.col("label").alias("y_true"), F.lit(0.5).alias("p_up"), F.lit(1).alias("y_pred"))


def test_failed_unit_is_recorded_and_others_go_on(spark):
    rows = window_rows(spark)
    units = [{"profile": M.Profile("logit", p), "seed": 101} for p in ("good", "bad")]
    got = M.run_trials(units, lambda u: (rows, rows), fake)
    ledger = {r["hpo_profile_id"]: r for r in M.trial_rows(got, ["model_family", "hpo_profile_id", "seed"], spark).collect()}
    assert ledger["good"]["fit_status"] == "completed" and ledger["good"]["n_rows"] == 40 and ledger["good"]["error"] is None
    assert ledger["bad"]["fit_status"] == "failed" and ledger["bad"]["macro_f1"] is None and "no convergence" in ledger["bad"]["error"]
    with pytest.raises(RuntimeError, match="no convergence"):
        M.run_units(units, lambda u: (rows, rows), fake)


def test_resume_adds_units_and_keeps_the_others(spark, tmp_path):
    rows, out = window_rows(spark), str(tmp_path / "wf")
    periods = [("p1", "2024-01-13", "2024-01-16"), ("p2", "2024-01-16", "2024-01-19")]
    good, bad = M.Profile("logit", "good"), M.Profile("logit", "bad")
    runs.walkforward(rows, periods, [good, bad], [101], out, 2, 2, hook=fake)
    ledger = spark.read.parquet(f"{out}/ledger")
    assert {(r["hpo_profile_id"], r["fit_status"]) for r in ledger.collect()} == {("good", "completed"), ("bad", "failed")}
    before = spark.read.parquet(f"{out}/predictions").count()
    done = spark.createDataFrame([tuple(r) for r in ledger.filter("fit_status = 'completed'").select("period_id", "model_family", "hpo_profile_id", "seed", "fit_status").collect()],
                                 "period_id string, model_family string, hpo_profile_id string, seed int, fit_status string")

    def mended(train, evals, profile, seed):
        assert profile.profile_id == "bad"
        return fake(train, evals, good, seed)

    runs.walkforward(rows, periods, [good, bad], [101], out, 2, 2, completed=done, hook=mended)
    assert spark.read.parquet(f"{out}/predictions").count() == 2 * before
    ledger = spark.read.parquet(f"{out}/ledger").collect()
    assert len(ledger) == 4 and {r["fit_status"] for r in ledger} == {"completed"}


def test_scaling_is_per_feature_over_time(spark):
    rows = spark.createDataFrame([("a", [1.0, 10.0, 3.0, 10.0]), ("b", [5.0, 10.0, 7.0, 10.0])], "sample_id string, features array<float>")
    s = M.scaling_of(rows, 2)
    assert s.mean == (4.0, 10.0) and s.std == (pytest.approx(5 ** 0.5), 1.0)
    assert s.apply(rows.filter("sample_id = 'a'")).first()["features"] == pytest.approx([-3 / 5 ** 0.5, 0.0, -1 / 5 ** 0.5, 0.0])


def test_copies_follow_class_weights(spark):
    rows = spark.createDataFrame([(f"s{i}", int(i < 400), 2.5 if i < 400 else 1.0) for i in range(1400)], "sample_id string, label int, weight double")
    n = {r["label"]: r["count"] for r in M.balanced_copies(rows, 7).groupBy("label").count().collect()}
    assert n[0] == 1000 and abs(n[1] - 1000) < 60


def plain_numbers(s):
    def text(d):
        out = format(d, "f")
        return out.rstrip("0").rstrip(".") if "." in out else out

    sci = []
    for pattern in TX.SCIENTIFIC:
        s = re.sub(pattern, lambda m: sci.append(text(Decimal(m[1]) * Decimal(10) ** int(m[2]))) or " ", s)
    s = re.sub(TX.POWER_OF_TEN, lambda m: sci.append(text(Decimal(10) ** int(m[1]))) or " ", s)
    s = re.sub(TX.RANGE_DASH, " ", s)
    for pattern in TX.THOUSANDS:
        s = re.sub(pattern, "", s)
    return sorted(re.findall(TX.PLAIN, s) + sci)


def test_numbers_equal_plain_decimal_arithmetic(spark):
    texts = ["1e20 and 9f3e20", "1e-20", r"3.2\times 10^{-4} of 5\cdot 10^2", "736{,}685 and 1,234,567", "10^{-3}, 10^5", "1--5 and 3–4", "0.50 -2 +3", "0e5 120e-2 00.70E1", "", "12.5e3x 4.7e-4."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "1e999999999999")], "doc_id long, text string")
    got: dict[int, list[str]] = {}
    for r in TX.number_inventory(df).collect():
        got.setdefault(r["doc_id"], []).extend([r["token"]] * r["n"])
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_numbers(t), t
    assert got[98] == ["1e999999999999"] and 99 not in got


def test_first_is_the_first_row_and_ratio_divides_sums(spark):
    df = spark.createDataFrame([(2, 5.0, 1.0), (1, 7.125, 2.0), (3, 3.0, 1.0)], "k int, v double, w double")
    specs = [("a", "k > 0", "v", "first", 1.0, 2, "7.13"), ("b", "k > 1", "v/w", "ratio", 10.0, 1, "40"), ("c", "k > 9", "v", "first", 1.0, 1, "1")]
    got = {r["number_id"]: (r["derived"], r["status"]) for r in RO.audit_numbers(df, specs, ["k"]).collect()}
    assert got == {"a": (7.13, "match"), "b": (40.0, "match"), "c": (None, "unresolved")}
    with pytest.raises(ValueError):
        RO.audit_numbers(df, specs)


def test_splits_are_whole_and_bounded(spark):
    def matrix(blocks):
        return spark.createDataFrame([(f"t{t}", b, float((t * 7 + b * 3) % 11)) for t in range(3) for b in range(blocks)], "trial string, block int, perf double")

    assert RS.cscv_splits(matrix(10), trial="trial", block="block", perf="perf").count() == 252
    with pytest.raises(PySparkException, match="too many splits"):
        RS.cscv_splits(matrix(33), trial="trial", block="block", perf="perf").count()


def test_random_band_for_three_seeds_ends_at_the_full_risk(spark):
    rng = random.Random(5)
    rows = [(s, f"x{i}", int(rng.random() < 0.3)) for i in range(300) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "seed int, sample_id string, correct int")
    last = SEL.permutation_band(df, 20, 9).orderBy(F.desc("grid_index")).first()
    risk = 1 - sum(r[2] for r in rows) / len(rows)
    assert last["risk_lo"] == pytest.approx(risk) and last["risk_hi"] == pytest.approx(risk)


def test_workers_get_the_package_from_any_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\nimport __spark_entry__ as e\nfrom sigmeter.session import build_session\n"
            "s = build_session('away', 'local[2]', **{'spark.sql.shuffle.partitions': '2', 'spark.ui.showConsoleProgress': 'false'})\n"
            "print('ROWS', e.queries()['k3_label_shuffle'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("gone", [("sigmeter/llm", "tests/llm"), ("sigmeter/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_works_without_the_training_data_folders(tmp_path, gone):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    left_out = {os.path.join(repo, g) for g in gone} | {os.path.join(repo, ".git")}
    shutil.copytree(repo, copy, ignore=lambda folder, names: [n for n in names if os.path.join(folder, n) in left_out or n == "__pycache__"])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', *e.queries(), *e.oracle_sql())"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    names = out.stdout.rpartition("NAMES")[2].split()
    assert "k1_block_bootstrap" in names and not [n for n in names if n.startswith("op") or n == "pipeline"], out.stderr[-2000:]


def test_model_runs_cover_their_rosters(spark, monkeypatch):
    from sigmeter.catalog import fitted
    from sigmeter.sources import predictions as P

    monkeypatch.setattr(fitted.MF, "run_roster", lambda data, units, n_features, width: M.Trials(None, [(u, "not fitted") for u in units]))
    sf, six = "/root/testdata/sf0.001", set(fitted.PROFILES)
    for run, keys, n in ((fitted.g14, ["fold_id", "candidate_id"], 4 * 9 * 2 * 3), (fitted.g15, ["fold_id", "candidate_id"], 6 * 6 * 2 * 3), (fitted.g16, ["period_id"], 6 * 2 * 3),
                         (fitted.g20, ["fold_id", "arm_id"], 3 * 4 * 2 * 3)):
        rows = run(spark, sf).select("model_family", "hpo_profile_id", "seed", *keys).collect()
        assert len(rows) == len(set(rows)) == n and {r["seed"] for r in rows} == set(P.SEEDS)
        assert run is fitted.g20 or {r["model_family"] for r in rows} == six


def test_planted_run_has_sentinels_of_every_fit(spark, monkeypatch):
    from sigmeter.catalog import fitted

    plain = fitted.MF.run_roster

    def fake(data, group, profile, seed):
        return data.part(group, "eval").select(*fitted.MF.IDS, F.col("label").cast("double").alias("p_up"))

    monkeypatch.setattr(fitted.MF, "run_roster", lambda *a: plain(*a, hook=fake))
    rows = [r for r in fitted.g20(spark, "/root/testdata/sf0.001").collect() if r["fit_status"] == "completed"]
    folds = {r["fold_id"] for r in rows}  # the smallest table has folds without windows to fit or score
    assert folds and len(rows) == len(set((r["fold_id"], r["arm_id"], r["seed"], r["model_family"]) for r in rows)) == 3 * 4 * 2 * len(folds)
    assert all(r["macro_f1"] > 0.49 and r["label_shuffle_p_value"] is not None and r["time_reverse_delta"] is not None for r in rows), rows[:3]
