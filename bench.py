"""Headline queries at one scale; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_majority_macro_f1", "d1_resample_bars", "f1_direction_labels", "e10_feature_frame", "f5_train_inner_folds",
    "h1_macro_f1", "h2_score_classifier", "h13_comparison_table", "h14_hpo_summary", "i4_calibration_summary", "i6_aurc",
    "i8_selective_grid", "k1_block_bootstrap", "k3_label_shuffle", "k7_cscv_pbo", "m1_robustness_slices", "m2_failure_slices",
    "m10_row_pooled_loo", "n1_roll_halfspread", "n4_partition_readout", "c3_align_baseline", "r3_sentence_statistics", "r5_title_match",
]


def main() -> None:
    from sigmeter.catalog import QUERIES
    from sigmeter.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # starts the executors; not timed
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
