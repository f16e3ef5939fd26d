"""Hand values and second implementations for the measurement operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmeter.functions import confusion as C
from sigmeter.functions.hypergeom import invert
from sigmeter.functions.student_t import lcb_agg, t975, t975_series
from sigmeter.operators import calibration as CAL, ranks as R, resample as RS, selective as SEL, slices as SL
from sigmeter.operators.micro import corwin_schultz, roll_halfspread, spread_partition


def frame(spark, y, pred, base=None, **extra):
    base = base or [0] * len(y)
    cols = {"y_true": y, "y_pred": pred, "base_pred": base, **extra}
    return spark.createDataFrame(list(zip(*cols.values())), list(cols))


def sums(df):
    return df.agg(*C.row_sums())


def np_f1(y, p):
    out = []
    for c in (0, 1):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        den = sum(a == c for a in y) + sum(b == c for b in p)
        out.append(2 * tp / den if den else 0.0)
    return sum(out) / 2


def test_per_class_hand_values(spark):
    r = sums(frame(spark, [0, 0, 1, 1, 1], [0, 1, 1, 1, 0])).select(
        C.precision_up().alias("pu"), C.recall_up().alias("ru"), C.macro_f1().alias("f"), C.balanced_accuracy().alias("b")).first()
    assert r["pu"] == pytest.approx(2 / 3) and r["ru"] == pytest.approx(2 / 3)
    assert r["f"] == pytest.approx((0.5 + 2 / 3) / 2) and r["b"] == pytest.approx((0.5 + 2 / 3) / 2)


def test_macro_f1_random(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        n = rnd.randint(1, 30)
        y, p = [rnd.randint(0, 1) for _ in range(n)], [rnd.randint(0, 1) for _ in range(n)]
        rows += [(g, a, b, 0) for a, b in zip(y, p)]
        want[g] = np_f1(y, p)
    df = spark.createDataFrame(rows, ["g", "y_true", "y_pred", "base_pred"]).groupBy("g").agg(*C.row_sums())
    for r in df.select("g", C.macro_f1().alias("f")).collect():
        assert r["f"] == pytest.approx(want[r["g"]])


def test_mcc_degenerate(spark):
    one_pred = sums(frame(spark, [0, 1, 1], [1, 1, 1])).select(C.mcc().alias("m")).first()["m"]
    one_true = sums(frame(spark, [1, 1, 1], [0, 1, 1])).select(C.mcc().alias("m")).first()["m"]
    assert one_pred == 0.0 and one_true is None


def test_student_t(spark):
    assert t975(1) == pytest.approx(12.706204736, abs=1e-8)
    assert t975(2) == pytest.approx(4.302652730, abs=1e-8)
    assert t975(10) == pytest.approx(2.228138852, abs=1e-8)
    got = spark.range(1).select(t975_series(F.lit(200)).alias("t")).first()["t"]
    assert got == pytest.approx(t975(200), abs=1e-9)
    v = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double").agg(lcb_agg(F.col("x")).alias("l")).first()["l"]
    assert v == pytest.approx(7 / 3 - t975(2) * np.std([1, 2, 4], ddof=1) / math.sqrt(3))
    assert spark.createDataFrame([(3.0,)], "x double").agg(lcb_agg(F.col("x")).alias("l")).first()["l"] == 3.0


def _reliability(spark, y, p, n, scheme):
    rows = [("g", f"{i:03d}", v, o, o) for i, (o, v) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "k string, sample_id string, value double, outcome int, y_true int")
    cells, edges = CAL.pieces_and_edges(df, ["k"], [n])
    edges = edges.filter(F.col("binning_scheme") == scheme)
    return CAL.reliability_bins(cells, edges, ["k"])


def test_reliability_equal_width(spark):
    bins = _reliability(spark, [1, 0, 1, 1, 0, 0, 1, 0], [.9, .8, .7, .65, .3, .2, .25, .1], 2, "equal_width")
    rows = bins.orderBy("bin_index").collect()
    assert [r["mean_predicted"] for r in rows] == pytest.approx([0.2125, 0.7625])
    assert [r["empirical_frequency"] for r in rows] == pytest.approx([0.25, 0.75])
    e = CAL.calibration_errors(bins, ["k"]).first()
    assert e["ece"] == pytest.approx(0.025) and e["mce"] == pytest.approx(0.0375)


def test_brier_identity_on_constant_bins(spark):
    bins = _reliability(spark, [1, 0, 1, 0], [.8, .8, .4, .4], 2, "equal_mass")
    b = CAL.brier_terms(bins, ["k"]).first()
    raw = np.mean([(p - y) ** 2 for p, y in zip([.8, .8, .4, .4], [1, 0, 1, 0])])
    assert b["brier_uncertainty"] == pytest.approx(0.25)
    assert b["brier_reliability"] - b["brier_resolution"] + b["brier_uncertainty"] == pytest.approx(raw)


def ranked(spark, correct, conf, keys):
    rows = [("s", k, 1, c, v, c) for k, c, v in zip(keys, correct, conf)]
    df = spark.createDataFrame(rows, "seed string, sample_id string, y_true int, y_pred int, confidence double, correct int")
    return R.confidence_rank(df, ["seed"])


def test_risk_coverage_and_aurc(spark):
    rk = ranked(spark, [1, 1, 0, 1], [.9, .8, .7, .6], list("abcd"))
    risk = [r["selective_risk"] for r in SEL.risk_coverage_curve(rk, ["seed"]).orderBy("n_covered").collect()]
    assert risk == pytest.approx([0, 0, 1 / 3, 0.25])
    s = R.selective_summary(rk, ["seed"]).first()
    assert s["oracle_aurc"] == pytest.approx(0.0625) and s["augrc"] == pytest.approx(0.125)
    assert s["aurc"] == pytest.approx(np.mean([0, 0, 1 / 3, 0.25])) and s["full_coverage_risk"] == 0.25


def test_tie_order(spark):
    rk = ranked(spark, [1, 0, 1, 0], [.5] * 4, list("dcba"))
    risk = [r["selective_risk"] for r in SEL.risk_coverage_curve(rk, ["seed"]).orderBy("n_covered").collect()]
    assert risk == pytest.approx([1, 0.5, 2 / 3, 0.5])


def test_ranks_with_everything_tied(spark):
    """One score for all rows, in one group: ranks are still dense and exact."""
    df = spark.range(0, 5000).select(F.lit("g").alias("g"), F.lit(0.5).alias("s"), F.format_string("%06d", "id").alias("k"))
    rk = R.group_rank(df, ["g"], [F.col("s").desc(), F.col("k").asc()])
    bad = rk.filter(F.col("rk") != F.col("k").cast("int") + 1).count()
    assert bad == 0 and rk.count() == 5000


def test_roc_auc_under_ties(spark):
    y, s = [0, 0, 1, 1, 1, 0], [.1, .4, .4, .8, .8, .8]
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    df = spark.createDataFrame([("g", f"{i}", a, b) for i, (a, b) in enumerate(zip(y, s))], "g string, sample_id string, y_true int, p_up double")
    assert R.roc_auc(df, ["g"]).first()["roc_auc"] == pytest.approx(np.mean(pairs))


def test_exact_quantiles(spark):
    v = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([("g", float(x), f"{i:04d}") for i, x in enumerate(v)], "g string, v double, k string")
    q = R.exact_quantiles(R.group_rank(df, ["g"], [F.col("v").asc(), F.col("k").asc()]), ["g"], "v", [0.0, 0.025, 0.5, 0.9, 1.0])
    for r in q.collect():
        assert r["quantile"] == pytest.approx(np.quantile(v, r["q"]))


def matrix(spark, rows):
    return spark.createDataFrame([(f"t{i}", j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "trial string, block int, perf double")


def test_pbo_hand_values(spark):
    r = RS.cscv_pbo(matrix(spark, [[3, 3, 3, 3], [1, 1, 1, 1]])).first()
    assert r["pbo"] == 0 and r["n_combinations"] == 6
    flat = RS.cscv_pbo(matrix(spark, [[1] * 7] * 4)).first()
    assert flat["pbo"] == 0 and flat["median_logit"] == pytest.approx(0) and (flat["is_block_count"], flat["os_block_count"]) == (3, 4)
    assert RS.cscv_pbo(matrix(spark, [[4, 3, 1, 0], [0, 1, 3, 5]])).first()["pbo"] > 0.5


def cells_of(spark, days, rows, model, base, seed=1):
    rnd = random.Random(seed)
    data = []
    for d in range(days):
        for i in range(rows):
            y = rnd.randint(0, 1)
            data.append((101, "A", f"d{d:02d}", f"{d}-{i}", i, y, model(y, rnd), base(y, rnd)))
    df = spark.createDataFrame(data, "seed int, ticker string, trading_day string, sample_id string, target_timestamp int, y_true int, y_pred int, base_pred int")
    return df, df.groupBy("seed", "ticker", "trading_day").agg(*C.row_sums())


def test_bootstrap_perfect_and_identical(spark):
    _, c = cells_of(spark, 20, 15, lambda y, r: y, lambda y, r: r.randint(0, 1))
    ci = RS.block_bootstrap(c, ["seed"], 300).first()
    assert ci["lcb"] > 0 and ci["n_blocks"] == 20 and ci["lcb"] <= ci["point"] <= ci["ucb"]
    _, same = cells_of(spark, 20, 15, lambda y, r: 1, lambda y, r: 1)
    ci = RS.block_bootstrap(same, ["seed"], 100).first()
    assert ci["lcb"] == ci["ucb"] == 0
    _, one = cells_of(spark, 1, 15, lambda y, r: y, lambda y, r: 0)
    ci = RS.block_bootstrap(one, ["seed"], 50).first()
    assert ci["lcb"] == ci["ucb"] == pytest.approx(ci["point"])


def test_label_shuffle_destroys_a_real_edge(spark):
    df, c = cells_of(spark, 12, 10, lambda y, r: y, lambda y, r: r.randint(0, 1))
    s = RS.label_shuffle(c, ["seed"], 100).first()
    assert s["label_shuffle_p_value"] <= 0.02 and s["label_shuffle_mean"] < s["observed_delta"] - 0.2
    rev = RS.time_reverse(df, ["seed"]).first()["time_reverse_delta"]
    assert rev < s["observed_delta"]


def test_hypergeometric_matches_the_distribution():
    from math import comb

    n, k, d = 20, 8, 9
    u = (np.arange(20000) + 0.5) / 20000
    x = invert(u, np.full(u.size, n), np.full(u.size, k), np.full(u.size, d))
    for v in range(0, 9):
        want = comb(k, v) * comb(n - k, d - v) / comb(n, d) if d - v <= n - k else 0
        assert abs(np.mean(x == v) - want) < 1e-3
    big = invert(np.array([0.5, 0.5]), np.array([2e11, 10]), np.array([1e11, 4]), np.array([1e6, 3]))
    assert abs(big[0] - 5e5) < 2 and 0 <= big[1] <= 3


def test_leave_one_out_equals_dropping_rows(spark):
    rnd = random.Random(3)
    data = [(101 + i % 2, f"wf_{rnd.randint(0, 3)}", f"T{rnd.randint(0, 2)}", "d", rnd.randint(0, 1), rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "seed int, period_id string, ticker string, trading_day string, y_true int, y_pred int, base_pred int")
    c = df.groupBy("seed", "period_id", "ticker", "trading_day").agg(*C.row_sums())
    for r in SL.row_pooled_loo(c, ["period_id", "ticker"]).collect():
        axis = 1 if r["estimand"].endswith("period_id") else 2
        deltas = []
        for s in (101, 102):
            keep = [x for x in data if x[0] == s and x[axis] != r["left_out"]]
            deltas.append(np_f1([x[4] for x in keep], [x[5] for x in keep]) - np_f1([x[4] for x in keep], [x[6] for x in keep]))
        assert r["delta_after_drop"] == pytest.approx(np.mean(deltas))


def test_terciles_of_two_days(spark):
    df = spark.createDataFrame([("A", "d1")] * 2 + [("A", "d2")] * 3, ["ticker", "trading_day"])
    assert {r["trading_day"]: r["activity_tercile"] for r in SL.activity_terciles(df).collect()} == {"d1": "mid", "d2": "high"}


def test_spread_cells(spark):
    vals = [0.49, 0.5, 0.51, 1.0, 1.01, 2.0, 2.01]
    df = spark.createDataFrame([("A", f"d{i}", v, "ok") for i, v in enumerate(vals)], "ticker string, trading_day string, halfspread double, status string")
    got = [r["cell"] for r in spread_partition(df, 1.0).orderBy("trading_day").collect()]
    assert got == ["ratio_le_0p5"] * 2 + ["ratio_0p5_to_1"] * 2 + ["ratio_1_to_2"] * 2 + ["ratio_gt_2"]


def bounce_bars(spark, days=30, bars=78, half=6e-4, bump=None):
    rnd = random.Random(7)
    rows = []
    for d in range(days):
        mid = 100.0
        for i in range(bars):
            mid *= math.exp(rnd.gauss(0, 2e-5))
            px = mid * (1 + half * rnd.choice((-1, 1)))
            if bump == d and i == 10:
                px *= 1.05
            rows.append(("A", f"2022-{1 + d // 28:02d}-{1 + d % 28:02d}", d * 1000 + i, px, px * 1.0001, px * 0.9999))
    return spark.createDataFrame(rows, "ticker string, trading_day string, timestamp int, close double, high double, low double")


def test_roll_recovers_the_half_spread_and_excludes_its_own_day(spark):
    base = roll_halfspread(bounce_bars(spark)).orderBy("trading_day").collect()
    assert base[0]["status"] == "insufficient_history"
    assert np.mean([r["halfspread"] for r in base[-10:]]) == pytest.approx(6e-4, rel=0.15)
    hit = roll_halfspread(bounce_bars(spark, bump=20)).orderBy("trading_day").collect()
    assert hit[20]["halfspread"] == base[20]["halfspread"] and hit[21]["halfspread"] != base[21]["halfspread"]
    assert corwin_schultz(bounce_bars(spark)).filter("cs_halfspread < 0").count() == 0


def test_registered_queries_use_the_declared_draws(monkeypatch):
    from sigmeter.catalog import closing, robust, spreads

    assert (robust.N_BOOT, closing.N_BOOT, spreads.N_BOOT, closing.BAND_BOOT) == (1000,) * 4 and (robust.N_PERM, robust.N_PERM_GUARDED) == (200, 50)
    seen = []
    monkeypatch.setattr(closing.SEL, "permutation_band", lambda rows, n, seed: seen.append(n))
    monkeypatch.setattr(closing.SEL, "with_confidence", lambda *a: None)
    monkeypatch.setattr(closing, "rounded", lambda x: x)
    monkeypatch.setattr(closing.P, "scored", lambda *a: None)
    closing.i11(None, "")
    assert seen == [1000]
