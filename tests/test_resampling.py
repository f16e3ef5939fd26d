"""Splitting tree, bootstrap sums and resampled risk curves against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmeter.functions import splitting as S
from sigmeter.functions.scalar import harmonic, harmonic_numbers
from sigmeter.operators import resample as RS, selective as SEL
from sigmeter.operators.ranks import confidence_rank

DRAWS = np.arange(600)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1024, 1025, 2500])
def test_counts_are_multinomial_and_free_of_the_cut(n):
    whole = S.all_multiplicities(11, 0, 600, n)
    assert whole.shape == (600, n) and (whole.sum(1) == n).all() and (whole >= 0).all()
    pieces = np.concatenate([S.multiplicities(11, DRAWS[100:130], n, a, 4) for a in range(0, n, 16)], 1)
    assert (pieces == whole[100:130]).all()
    if n >= 100:
        assert abs(whole.var() - (1 - 1 / n)) < 0.02
        assert abs((whole == 0).mean() - (1 - 1 / n) ** n) < 0.005
        half = whole[:, : n // 2].sum(1)
        p = (n // 2) / n
        assert abs(half.mean() - n * p) < 4 * np.sqrt(n * p * (1 - p) / 600) and 0.8 < half.var() / (n * p * (1 - p)) < 1.2


@pytest.mark.parametrize("n, p", [(5, 0.5), (40, 0.3), (900, 0.5), (5000, 0.25)])
def test_inversion_gives_the_distribution(n, p):
    u = (np.arange(200_000) + 0.5) / 200_000
    k = S.binomial(np.full(len(u), n), p, u)
    assert (np.diff(k) >= 0).all() and k.mean() == pytest.approx(n * p, rel=1e-3) and k.var() == pytest.approx(n * p * (1 - p), rel=5e-3)


def test_draw_sums_equal_counts_times_blocks_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(s, f"T{t}", f"d{d:04d}", rng.randrange(50), rng.random()) for s in (1, 2) for t in range(2) for d in range(700)]
    blocks = spark.createDataFrame(rows, "seed int, ticker string, trading_day string, n int, value double")
    idx = RS.index_blocks(blocks, ["seed"]).collect()
    got = {(r.seed, r.draw): r for r in RS.bootstrap_draws(blocks, ["seed"], ["n", "value"], 300, 77).collect()}
    assert len(got) == 600
    counts = S.all_multiplicities(77, 0, 300, 1400)
    for seed in (1, 2):
        mine = sorted((r for r in idx if r.seed == seed), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(1400))
        n, v = counts @ np.array([r.n for r in mine]), counts @ np.array([r.value for r in mine])
        assert all(got[seed, d].n == n[d] and got[seed, d].value == pytest.approx(v[d]) and got[seed, d].n_blocks == 1400 for d in range(300))
    used = RS.dealt(RS.index_blocks(blocks, ["seed"]), ["seed"], 1000).withColumn("_task", F.spark_partition_id()).select("_task").distinct().count()
    assert used > 4  # 2 seeds x 2 ranges x 4 chunks


def test_a_slice_that_is_a_block_column(spark):
    blocks = spark.createDataFrame([("A", "1", 3), ("A", "2", 5), ("B", "1", 7)], "ticker string, trading_day string, n int")
    got = RS.bootstrap_draws(blocks, ["ticker"], ["n"], 20, 1).collect()
    assert {r.n for r in got if r.ticker == "B"} == {7} and {r.n for r in got if r.ticker == "A"} <= {6, 8, 10} and len(got) == 40


def brute_curves(ranked, n_boot, seed, days):
    grid = SEL.GRID_MIN + np.arange(SEL.GRID_SIZE) * SEL.GRID_STEP
    counts = S.all_multiplicities(seed, 0, n_boot, len(days))
    curves, stats = {}, {}
    for s, rows in ranked.items():
        day = np.array([days[d] for d, _ in rows])
        ok = np.array([c for _, c in rows])
        for d in range(n_boot):
            m = counts[d][day]
            c, e, seen = np.cumsum(m), np.cumsum(m * (1 - ok)), m > 0
            curves[s, d] = np.interp(grid, c[seen] / c[-1], e[seen] / c[seen])
            rep = np.repeat(ok, m)
            k = np.arange(1, len(rep) + 1)
            good = int(rep.sum())
            oracle = np.concatenate([np.ones(good), np.zeros(len(rep) - good)])
            stats[s, d] = (np.mean(1 - np.cumsum(rep) / k), np.mean(1 - np.cumsum(oracle) / k), 1 - good / len(rep))
    return curves, stats


@pytest.mark.parametrize("block", [1 << 14, 37])
def test_resampled_curves_and_intervals_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(SEL, "RANK_BLOCK", block)
    rng = random.Random(8)
    rows = [(s, f"d{rng.randrange(25):02d}", f"x{i:04d}", round(rng.random(), 2), int(rng.random() < 0.6)) for s in (1, 2, 3) for i in range(300)]
    df = spark.createDataFrame(rows, "seed int, trading_day string, sample_id string, confidence double, correct int")
    ranked = confidence_rank(df, ["seed"])
    days = {r.trading_day: r.idx for r in RS.index_blocks(df.select("trading_day").distinct(), [], ["trading_day"]).collect()}
    plain = {s: [(d, c) for _, _, d, c in sorted((-conf, sid, d, c) for seed, d, sid, conf, c in rows if seed == s)] for s in (1, 2, 3)}
    curves, stats = brute_curves(plain, 40, 5, days)
    points, scalars = SEL.resampled_curves(ranked, 40, 5)
    got = points.toPandas()
    assert len(got) == 3 * 40 * SEL.GRID_SIZE
    for (s, d), part in got.groupby(["seed", "draw"]):
        assert np.allclose(part.sort_values("grid_index").risk, curves[s, d], atol=1e-12)
    for r in scalars.collect():
        a, o, f = stats[r.seed, r.draw]
        assert (r.aurc, r.oracle_aurc, r.errors / r.covered) == pytest.approx((a, o, f), abs=1e-9)
    bands = SEL.bootstrap_bands(points, scalars).orderBy("grid_index").collect()
    mean = np.array([np.mean([curves[s, d] for s in (1, 2, 3)], 0) for d in range(40)])
    full = np.array([np.mean([stats[s, d][2] for s in (1, 2, 3)]) for d in range(40)])
    assert np.allclose([r.risk_lo for r in bands], np.percentile(mean, 2.5, axis=0)) and np.allclose([r.delta_hi for r in bands], np.percentile((full[:, None] - mean) * 100, 97.5, axis=0))
    m = np.array([np.mean([stats[s, d] for s in (1, 2, 3)], 0) for d in range(40)]).T
    a, o, f = m
    want = {"aurc": a, "delta": a - f, "e_aurc": a - o, "gap": (f - a) / (f - o), "rel": (a - o) / (f - o)}
    for r in SEL.scalar_intervals(scalars).collect():
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(want[r.statistic], [2.5, 97.5]))) and r.n_draws == 40


def test_harmonic_forms_agree(spark):
    n = [0, 1, 5, 31, 32, 1000, 10**6]
    cols = spark.createDataFrame([(x,) for x in n], "n long").select(harmonic(F.col("n")).alias("h")).collect()
    assert np.allclose([r.h for r in cols], harmonic_numbers(np.array(n)), atol=1e-12)
