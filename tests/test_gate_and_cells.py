"""Selection gate, expanding sums and calibration cells against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmeter.operators import calibration as CAL, decide as DE, folds as FD


def test_every_gate_case_has_its_decision(spark):
    from sigmeter.catalog import QUERIES

    rows = {r["case_id"]: r for r in QUERIES["p3_selection_bundle"](spark, "/root/testdata/sf0.01").collect()}
    want = {"as_is": None, "empty": 0, "failed_trial": 1, "nothing_eligible": 2, "one_profile": 3}
    for case, i in want.items():
        r = rows[case]
        assert (r["decision"], r["block_reason"]) == ((DE.READY, "") if i is None else DE.GATE[i]) and r["ready_for_next_stage"] == (i is None)
    assert rows["as_is"]["primary"] and rows["as_is"]["fallback"] and rows["one_profile"]["primary"] and rows["one_profile"]["fallback"] is None
    assert rows["failed_trial"]["primary"] is None and rows["failed_trial_allowed"]["primary"] != rows["as_is"]["primary"]


def test_expanding_sums_equal_repeated_history(spark):
    rng = random.Random(2)
    rows = [(dt.datetime(1995, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 365 * 4)), rng.randrange(2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "target_timestamp timestamp_ntz, y_true int")
    periods = spark.createDataFrame([(f"p{y}", dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1)) for y in (1996, 1997)], "period_id string, period_start timestamp_ntz, period_end timestamp_ntz")
    plain = FD.walkforward_rows(df, periods).groupBy("period_id", "fold_side").agg(F.count("*").alias("n"), F.sum("y_true").alias("up"))
    got = FD.expanding_sums(df, periods, {"n": F.lit(1), "up": F.col("y_true")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))

@pytest.mark.parametrize("shape, crowded", [("even", 1 << 20), ("ties", 1 << 20), ("narrow", 1 << 20), ("even", 0), ("ties", 0), ("narrow", 0)])
def test_cells_give_exact_edges_and_bins(spark, monkeypatch, shape, crowded):
    monkeypatch.setattr(CAL, "CROWDED", crowded)
    rng = random.Random(6)
    draw = {"even": rng.random, "ties": lambda: rng.choice([0.0, 0.1, 0.25, 0.5, 1.0]), "narrow": lambda: 0.5 + rng.random() * 1e-9}[shape]
    rows = [(g, f"T{i % 2}", draw(), rng.randrange(2)) for g in ("a", None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, part string, value double, outcome int").withColumn("y_true", F.col("outcome"))
    both = lambda x: x.withColumn("part", F.explode(F.array(F.col("part"), F.lit("all"))))
    pieces, edges = CAL.pieces_and_edges(df, ["g", "part"], [5, 10], both)
    told = {(r.g, r.part, r.binning_scheme, r.n_bins): r.edges for r in edges.collect()}
    assert len(told) == 2 * 3 * 2 * 2
    bins = {}
    for r in CAL.reliability_bins(pieces.na.fill("none", ["g"]), edges.na.fill("none", ["g"]), ["g", "part"]).collect():
        bins.setdefault((None if r.g == "none" else r.g, r.part, r.binning_scheme, r.n_bins), {})[r.bin_index] = (r.n_rows, r.mean_predicted, r.empirical_frequency)
    for (g, part, scheme, n), e in told.items():
        mine = [(v, o) for gg, p, v, o in rows if gg == g and part in (p, "all")]
        v, o = np.array([x for x, _ in mine]), np.array([x for _, x in mine])
        want = np.linspace(0, 1, n + 1) if scheme == "equal_width" else np.unique(np.quantile(v, [i / n for i in range(n + 1)]))
        assert np.allclose(e, want, atol=1e-12) or shape == "narrow" and np.allclose(sorted(set(e)), want, atol=1e-12)
        at = np.clip(np.searchsorted(e, v, "right") - 1, 0, len(e) - 2)
        got = bins[g, part, scheme, n]
        assert set(got) == set(at.tolist())
        for b, (rows_, mean, freq) in got.items():
            assert rows_ == (at == b).sum() and mean == pytest.approx(v[at == b].mean()) and freq == pytest.approx(o[at == b].mean())
