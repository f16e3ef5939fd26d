"""One test per finding of the fourth review round: each failed before its change."""

import random
import re

SCHEMA = "seed int, ticker string, trading_day string, target_timestamp int, sample_id string, y_true int, y_pred int, base_pred int"


def _blocks(sizes, seeds=(101, 202)):
    rnd = random.Random(7)
    rows = [(s, f"T{b}", "d", i // 3, f"{i:06d}", *(rnd.randint(0, 1) for _ in range(3))) for s in seeds for b, n in enumerate(sizes) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def _largest_broadcast(df):
    """Most rows that any broadcast of the run held, and what the run returned."""
    rows = df.collect()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    held = re.findall(r"BroadcastQueryStage \(\d+\), Statistics\(sizeInBytes=[^,]*, rowCount=([0-9.E+]+)\)", df._jdf.queryExecution().explainString(mode))
    return max(map(float, held)), rows  # one at least, of the files' offsets


def test_reversal_broadcasts_no_rows(spark):
    from sigmeter.operators import resample as RS

    sizes = [700, 1, 64, 1300]
    df = spark.createDataFrame(_blocks(sizes), SCHEMA)
    assert _largest_broadcast(RS.time_reverse(df, ["seed"]))[0] < sum(sizes)  # blocks and files, never rows


def test_reversal_equals_brute_force(spark):
    from sigmeter.operators import resample as RS

    for sizes in ([1], [2, 3, 1, 1], [63, 64, 65, 127, 128, 129, 1, 200, 190], [5000, 7]):
        rows = _blocks(sizes)
        rows = [(*r[:5], None if i % 41 == 0 else r[5], None if i % 37 == 0 else r[6], r[7]) for i, r in enumerate(rows)]
        lost = [(101, None, "d", 1, "x", 1, 1, 1), (101, None, "d", 2, "y", 1, 1, 1)]  # blocks without a key take no part
        got = {r["seed"]: r.asDict() for r in RS.reversed_sums(spark.createDataFrame(rows + lost, SCHEMA), ["seed"]).collect()}
        for seed in (101, 202):
            want = dict.fromkeys(("n", "p", "pp", "tp", "bp", "btp"), 0)
            for b in range(len(sizes)):
                block = sorted((r for r in rows if r[0] == seed and r[1] == f"T{b}"), key=lambda r: r[3:5])
                for a, z in zip(block, block[::-1]):
                    y, p = a[5] or 0, z[6] or 0
                    for k, v in (("n", 1), ("p", y), ("pp", p), ("tp", y * p), ("bp", a[7]), ("btp", y * a[7])):
                        want[k] += v
            assert {k: got[seed][k] or 0 for k in want} == want, sizes


def test_sentinels_make_predictions_once_and_broadcast_no_rows(spark, monkeypatch):
    from sigmeter.catalog import QUERIES
    from sigmeter.sources import predictions as P

    made, live = [], P._live
    monkeypatch.setattr(P, "_live", lambda *a: made.append(a) or live(*a))
    most, got = _largest_broadcast(QUERIES["k9_sentinel_frames"](spark, "/root/testdata/sf0.01"))
    assert most < sum(r["n_rows"] for r in got) / 2 and len(made) == 1
