"""Queries over planted labels, selection rules, fingerprints, bands and document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confusion as C
from ..operators import (decide as DE, features as FT, folds as FD, guards as G, integrity as Q, joins as J, labels as L,
                         planted as PL, readouts as RO, records as RC, resample as RS, selective as SEL, slices as SL, textqa as TX)
from ..session import materialise, scratch_path
from ..sources import predictions as P, tape as TP
from ..sources.tables import table
from . import spreads as SP
from .base import RESUM_SQL, SUMS_SQL, bf1, cf1, cte, delta, f1, h01, lcb, query, r, rounded
from .ingest import CELLS, N_FOLDS, featured, labelled, members, train_cells, train_events
from .robust import BOOT_SEED, N_BOOT, PERM_SEED, SIX, boot_sql, hg
from .scoring import ALL, cells, ledger, stored

# ---- planted labels --------------------------------------------------------------------

ARMS = {"arm_000": 0.0, "arm_050": 0.05, "arm_150": 0.15, "arm_300": 0.3}
PLANT_SEED = 77


def u64(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE)"


cte("arm_list", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {s}::DOUBLE)" for a, s in ARMS.items()) + ") t(arm_id, strength)")
cte("ruled", """SELECT e.*, CASE WHEN f.log_return > 0 THEN 1 ELSE 0 END AS planted_rule_value, f.log_return IS NULL AS rule_is_null
  FROM events_train e JOIN features f ON f.ticker = e.ticker AND f."timestamp" = e.target_timestamp""")
cte("planted", f"""SELECT r.* EXCLUDE (label), a.arm_id, a.strength, r.label AS real_label, CASE WHEN {u64(f"'{PLANT_SEED}|' || a.arm_id || '|' || r.sample_id")} < 0.5::DOUBLE + a.strength
  THEN planted_rule_value ELSE 1 - planted_rule_value END AS label FROM ruled r, arm_list a""")


def ruled(spark, sf):
    return PL.rule_values(train_events(spark, sf), featured(spark, sf))


@query("f8_planted_rule_values", "SELECT sample_id, planted_rule_value, rule_is_null FROM ruled")
def f8(spark, sf):
    return ruled(spark, sf).select("sample_id", "planted_rule_value", "rule_is_null")


# Planted defects of the bars: one hour is gone, another is there twice.
@query("c4_planted_join", """WITH b AS (SELECT 'as_is' AS variant, ticker, "timestamp" AS t FROM bars UNION ALL SELECT 'planted', ticker, "timestamp" FROM bars WHERE hour("timestamp") <> 11
    UNION ALL SELECT 'planted', ticker, "timestamp" FROM bars WHERE hour("timestamp") = 13),
  k AS (SELECT variant, ticker, t, count(*) AS n FROM b GROUP BY 1, 2, 3)
  SELECT v.variant, count(*)::BIGINT AS left_rows, count_if(k.n IS NULL)::BIGINT AS unmatched_rows, max(d.dups)::BIGINT AS duplicate_keys
  FROM events_train e CROSS JOIN (SELECT unnest(['as_is', 'planted']) AS variant) v JOIN (SELECT variant, count_if(n > 1) AS dups FROM k GROUP BY 1) d ON d.variant = v.variant
  LEFT JOIN k ON k.variant = v.variant AND k.ticker = e.ticker AND k.t = e.target_timestamp GROUP BY 1""")
def c4(spark, sf):
    bars = TP.bars(spark, sf).select("ticker", F.col("timestamp").alias("target_timestamp"))
    hour = F.hour("target_timestamp")
    bad, out = bars.filter(hour != 11).unionByName(bars.filter(hour == 13)), None
    for name, b in (("as_is", bars), ("planted", bad)):
        row = J.join_report(train_events(spark, sf), b, ["ticker", "target_timestamp"], "planted").select(F.lit(name).alias("variant"), "left_rows", "unmatched_rows", "duplicate_keys")
        out = row if out is None else out.unionByName(row)
    return out


@query("f9_relabel_uniforms", f"""SELECT sample_id, {r(u64(f"'{PLANT_SEED}|arm_050|' || sample_id"), 12)} AS u FROM facts""")
def f9(spark, sf):
    return rounded(P.facts(spark, sf).select("sample_id", PL.relabel_uniform(PLANT_SEED, F.lit("arm_050"), F.col("sample_id")).alias("u")), 12)


@query("f10_planted_labels", "SELECT sample_id, arm_id, label FROM planted")
def f10(spark, sf):
    return PL.inject(ruled(spark, sf), ARMS, PLANT_SEED).select("sample_id", "arm_id", "label")


@query("f10_injection_stats", f"""SELECT arm_id, strength, count(*)::BIGINT AS n_rows, {r('avg(planted_rule_value)')} AS rule_positive_rate, count_if(rule_is_null)::BIGINT AS rule_nan_count,
  {r('avg((label = planted_rule_value)::INTEGER)')} AS realized_agreement_rate, {r('avg(label)')} AS synthetic_up_prior, {r('avg(real_label)')} AS real_up_prior FROM planted GROUP BY 1, 2""")
def f10s(spark, sf):
    return rounded(PL.injection_stats(PL.inject(ruled(spark, sf), ARMS, PLANT_SEED)))


# Trials of the planted arms over the large fact table: the rule is y_true, the model knows it.
cte("arm_cells", f"""SELECT arm_id, strength, period_id AS fold_id, seed, ticker, {SUMS_SQL} FROM (SELECT s.period_id, s.seed, s.ticker, a.arm_id, a.strength, s.base_pred, s.y_true AS y_pred,
    CASE WHEN {u64(f"'{PLANT_SEED}|' || a.arm_id || '|' || s.sample_id")} < 0.5::DOUBLE + a.strength THEN s.y_true ELSE 1 - s.y_true END AS y_true FROM scored_one s, arm_list a) GROUP BY 1, 2, 3, 4, 5""")
cte("arm_trials", f"""SELECT arm_id, strength, fold_id, seed, 'completed' AS fit_status, {bf1()} AS dummy_macro_f1, {delta()} AS delta_vs_dummy, positive_ticker_count FROM
  (SELECT arm_id, strength, fold_id, seed, count_if({delta()} > 0) AS positive_ticker_count, {RESUM_SQL} FROM arm_cells GROUP BY 1, 2, 3, 4)""")
cte("arm_agg", f"""SELECT arm_id, strength, count(*) AS expected_rows, count(*) AS completed_rows, avg(delta_vs_dummy) AS mean_delta, {lcb('delta_vs_dummy')} AS lcb_delta,
  min(positive_ticker_count) AS min_positive_ticker_count FROM arm_trials GROUP BY 1, 2""")


def arm_aggregates(spark, sf):
    x = P.scored(spark, sf).select("sample_id", "period_id", "seed", "ticker", "base_pred", F.col("y_true").alias("planted_rule_value"), F.col("y_true").alias("label"))
    x = PL.inject(x, ARMS, PLANT_SEED).select("arm_id", "strength", "period_id", "seed", "ticker", F.col("label").alias("y_true"),
                                              F.col("planted_rule_value").alias("y_pred"), "base_pred")
    keys = ["arm_id", "strength", "period_id", "seed"]
    t = x.groupBy(*keys, "ticker").agg(*C.row_sums())
    led = t.groupBy(*keys).agg(F.count_if(C.delta_f1() > 0).alias("positive_ticker_count"), *C.resum()).select(
        *keys, "positive_ticker_count", F.lit("completed").alias("fit_status"), C.delta_f1().alias("delta_vs_dummy"), C.base_f1().alias("dummy_macro_f1"))
    return RO.group_aggregates(led, ["arm_id", "strength"])


@query("g20_planted_arm_aggregates", f"""SELECT arm_id, strength, expected_rows::BIGINT AS expected_rows, completed_rows::BIGINT AS completed_rows, {r('mean_delta')} AS mean_delta, {r('lcb_delta')} AS lcb_delta,
  min_positive_ticker_count::BIGINT AS min_positive_ticker_count FROM arm_agg""")
def g20(spark, sf):
    a = arm_aggregates(spark, sf)
    return rounded(a.select("arm_id", "strength", "expected_rows", "completed_rows", "mean_delta", "lcb_delta", "min_positive_ticker_count"))


BAND_ABS = 0.01


@query("p8_planted_criteria", f"""WITH a AS (SELECT *, mean_delta > 0 AS fm, lcb_delta > 0 AS fl, min_positive_ticker_count >= 3 AS ft, lag(mean_delta) OVER (ORDER BY strength) AS prev FROM arm_agg),
  g AS (SELECT bool_and(strength <> 0 OR (NOT fl AND abs(mean_delta) <= {BAND_ABS} AND NOT (fm AND fl AND ft))) AS p1_pass, bool_and(prev IS NULL OR prev < mean_delta) AS p2_monotone_pass,
    bool_and(strength < 0.15 OR (fm AND fl AND ft)) AS p3_detection_pass, bool_or(strength = 0 AND fm AND fl AND ft) AS null_flags, bool_or(completed_rows < expected_rows) AS incomplete FROM a)
  SELECT *, CASE WHEN incomplete THEN 'incomplete_run_fix_and_rerun' WHEN null_flags AND NOT p3_detection_pass THEN 'fail_manufacturing_and_insensitive' WHEN null_flags THEN 'fail_manufacturing'
    WHEN NOT p3_detection_pass THEN 'fail_insensitive' WHEN NOT p2_monotone_pass OR NOT p1_pass THEN 'fail_nonmonotone_or_null_band' ELSE 'pass' END AS overall_outcome FROM g""")
def p8(spark, sf):
    return DE.planted_criteria(arm_aggregates(spark, sf), BAND_ABS, 3, 0.15)


# ---- parity and fingerprints -----------------------------------------------------------

cte("frozen_sets", """SELECT 'as_is' AS variant, sample_id, label FROM events_train
  UNION ALL SELECT 'planted', CASE WHEN hour(target_timestamp) = 10 THEN sample_id || 'x' ELSE sample_id END, CASE WHEN hour(target_timestamp) = 12 THEN 1 - label ELSE label END FROM events_train WHERE hour(target_timestamp) <> 11""")


@query("c13_event_parity", """SELECT variant, count(a)::BIGINT AS rebuilt_rows, count(b)::BIGINT AS frozen_rows, count_if(a IS NULL OR b IS NULL)::BIGINT AS one_sided_rows, count_if(a <> b)::BIGINT AS label_mismatches FROM
  (SELECT coalesce(e.variant, f.variant) AS variant, e.label AS a, f.label AS b FROM (SELECT variant, sample_id, label FROM events_train, (SELECT unnest(['as_is', 'planted']) AS variant)) e
   FULL JOIN frozen_sets f ON f.variant = e.variant AND f.sample_id = e.sample_id) GROUP BY 1""")
def c13(spark, sf):
    """The frozen cell rebuilt from train bars alone against the label freeze, and against one with dropped, renamed and relabelled rows."""
    lab = train_cells(spark, sf).filter((F.col("horizon_k") == TP.HORIZON_K) & (F.col("no_trade_band_bps") == TP.BAND_BPS) & F.col("valid_label"))
    frozen, hour = train_events(spark, sf), F.hour("target_timestamp")
    bad = frozen.filter(hour != 11).withColumns({"sample_id": F.when(hour == 10, F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id")),
                                                 "label": F.when(hour == 12, 1 - F.col("label")).otherwise(F.col("label"))})
    out = None
    for name, f in (("as_is", frozen), ("planted", bad)):
        row = J.event_parity(lab.select("sample_id", "label"), f).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def _fp_sql(src: str, group: str, key: str) -> str:
    h = f"sha256({key})"
    return f"""SELECT {group}, count(*)::BIGINT AS n_ids, sum(('0x' || substr({h}, 1, 13))::BIGINT)::VARCHAR AS hash_sum, bit_xor(('0x' || substr({h}, 14, 13))::BIGINT)::VARCHAR AS hash_xor FROM {src} GROUP BY ALL"""


def _text(df):
    return df.withColumns({"hash_sum": F.col("hash_sum").cast("string"), "hash_xor": F.col("hash_xor").cast("string")})


@query("q4_sample_id_fingerprint", _fp_sql("fold_member", "fold_id, fold_side", "sample_id"))
def q4(spark, sf):
    return _text(Q.fingerprint(members(spark, sf), ["fold_id", "fold_side"], F.col("sample_id")))


@query("q4_fact_fingerprint", _fp_sql("facts", "ticker", "sample_id"))
def q4b(spark, sf):
    return _text(Q.fingerprint(P.facts(spark, sf), ["ticker"], F.col("sample_id")))


@query("q4_ordered_sha256", """WITH b AS (SELECT fold_id, fold_side, ticker, trading_day, sha256(string_agg(sample_id, chr(10) ORDER BY target_timestamp, sample_id)) AS t, count(*) AS n FROM fold_member GROUP BY 1, 2, 3, 4),
  d AS (SELECT fold_id, fold_side, trading_day, sha256(string_agg(t, chr(10) ORDER BY ticker)) AS t, sum(n) AS n FROM b GROUP BY 1, 2, 3)
  SELECT fold_id, fold_side, sha256(string_agg(t, chr(10) ORDER BY trading_day)) AS ids_sha256, sum(n)::BIGINT AS n_ids FROM d GROUP BY 1, 2""")
def q4c(spark, sf):
    return Q.ordered_sha256(members(spark, sf), ["fold_id", "fold_side"], ["target_timestamp", "sample_id"], F.col("sample_id"))


@query("q5_events_identity", _fp_sql("events_train", "split", "sample_id || '|' || label"))
def q5(spark, sf):
    return _text(Q.fingerprint(train_events(spark, sf), ["split"], F.concat_ws("|", "sample_id", "label")))


@query("q4_recorded_digest", """SELECT fold_id, fold_side, sha256(string_agg(sample_id, chr(10) ORDER BY target_timestamp, sample_id)) AS ids_sha256, count(*)::BIGINT AS n_ids
  FROM fold_member GROUP BY 1, 2""")
def q4d(spark, sf):
    return Q.recorded_sha256(members(spark, sf), ["fold_id", "fold_side"], ["target_timestamp", "sample_id"], F.col("sample_id"))


@query("q5_recorded_digest", """SELECT split, sha256(string_agg(sample_id || '|' || label, chr(10) ORDER BY target_timestamp, ticker, sample_id)) AS ids_sha256, count(*)::BIGINT AS n_ids
  FROM events_train GROUP BY 1""")
def q5b(spark, sf):
    return Q.recorded_sha256(train_events(spark, sf), ["split"], ["target_timestamp", "ticker", "sample_id"], F.concat_ws("|", "sample_id", "label"))


# A record per ticker and day. Its delta is null where no label is up; records of an odd number of rows have no ``counts.up``.
RECORD_PATHS = ["scope.ticker", "counts.rows", "counts.up", "delta.rows_less_up", "counts.rows.deeper"]
_record_values = ["ticker", "n::VARCHAR", "CASE WHEN n % 2 = 0 THEN up::VARCHAR END", "CASE WHEN up > 0 THEN (n - up)::VARCHAR END", "NULL::VARCHAR"]
_record_status = ["'resolved'", "'resolved'", "CASE WHEN n % 2 = 0 THEN 'resolved' ELSE 'missing' END", "CASE WHEN up > 0 THEN 'resolved' ELSE 'recorded_null' END", "'missing'"]


@query("r16_record_fields", "WITH g AS (SELECT ticker, trading_day, count(*) AS n, sum(label)::BIGINT AS up FROM events_train GROUP BY 1, 2) " + " UNION ALL ".join(
    f"SELECT ticker, trading_day, '{p}' AS path, {v} AS value, {s} AS status FROM g" for p, v, s in zip(RECORD_PATHS, _record_values, _record_status)))
def r16(spark, sf):
    g = train_events(spark, sf).groupBy("ticker", "trading_day").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("up"))
    scope, rest = F.struct("ticker").alias("scope"), F.struct(F.when(F.col("up") > 0, F.col("rows") - F.col("up")).alias("rows_less_up")).alias("delta")
    keep = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(scope, F.struct("rows", "up").alias("counts"), rest), keep)
    odd = F.to_json(F.struct(scope, F.struct("rows").alias("counts"), rest), keep)
    records = g.select("ticker", "trading_day", F.when(F.col("rows") % 2 == 0, full).otherwise(odd).alias("record"))
    return RC.record_fields(records, ["ticker", "trading_day"], "record", RECORD_PATHS)


# Printed texts over the labelled events: right ones, wrong ones and one that no row answers.
TEXT_AUDIT = [RO.TextAudit("first_day", "date", "true", "trading_day", "from 2024-01-01 on, frozen 2024-02-30"),
              RO.TextAudit("first_day_of_views", "date", "ticker = 'view'", "trading_day", "from 1999-12-31 on"),
              RO.TextAudit("first_minute", "regex_int", "true", "sample_id", "minutes 0 to 59", pattern=r"T\d+:(\d+):"),
              RO.TextAudit("no_such_part", "regex_int", "true", "sample_id", "7", pattern=r"fold_(\d+)"),
              RO.TextAudit("up_share", "range", "true", "label", "between 30 and 70 percent", scale="100", digits=1, lo="30", hi="70"),
              RO.TextAudit("up_share_ends", "range", "true", "label", "between 30 and 71 percent", scale="100", digits=1, lo="30", hi="70"),
              RO.TextAudit("absent", "range", "ticker = 'absent'", "label", "1 to 2", lo="1", hi="2")]


def _text_audit_sql(s: RO.TextAudit) -> str:
    if s.mode == "range":
        v = f"(SELECT round(({s.how}({s.field}) * {s.scale})::DECIMAL(38,12), {s.digits})::DOUBLE FROM events_train WHERE {s.where})".replace("mean(", "avg(")
        ends = f"list_contains(regexp_extract_all('{s.printed}', '[0-9]+'), '{s.lo}') AND list_contains(regexp_extract_all('{s.printed}', '[0-9]+'), '{s.hi}')"
        return f"""SELECT '{s.number_id}' AS number_id, 'range' AS mode, NULL::VARCHAR AS derived_text, v AS derived, CASE WHEN v IS NULL THEN 'unresolved'
          WHEN v BETWEEN {s.lo} AND {s.hi} AND {ends} THEN 'match' ELSE 'review' END AS status FROM (SELECT {v} AS v)"""
    first = f"(SELECT {s.field}::VARCHAR FROM events_train WHERE {s.where} ORDER BY target_timestamp, sample_id LIMIT 1)"
    v, same = (first, f"contains('{s.printed}', v)") if s.mode == "date" else (
        f"nullif(regexp_extract({first}, '{s.pattern}', 1), '')", f"list_contains(list_transform(regexp_extract_all('{s.printed}', '[0-9]+'), lambda x: x::INT), v::INT)")
    return f"""SELECT '{s.number_id}' AS number_id, '{s.mode}' AS mode, v AS derived_text, NULL::DOUBLE AS derived, CASE WHEN v IS NULL THEN 'unresolved'
      WHEN {same} THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT {v} AS v)"""


@query("h19_text_audit", " UNION ALL ".join(map(_text_audit_sql, TEXT_AUDIT)))
def h19_texts(spark, sf):
    return RO.audit_texts(train_events(spark, sf), TEXT_AUDIT, ["target_timestamp", "sample_id"])


# The recorded side lacks the rows of one hour in fold_1, and all of fold_2's evaluation rows.
cte("recorded_members", "SELECT * FROM fold_member WHERE NOT (fold_id = 'fold_1' AND hour(target_timestamp) = 11) AND NOT (fold_id = 'fold_2' AND fold_side = 'eval')")


@query("c14_fingerprint_parity", f"""SELECT fold_id, fold_side, coalesce(a.n_ids = b.n_ids AND a.hash_sum = b.hash_sum AND a.hash_xor = b.hash_xor, false) AS identical
  FROM ({_fp_sql('fold_member', 'fold_id, fold_side', 'sample_id')}) a FULL JOIN ({_fp_sql('recorded_members', 'fold_id, fold_side', 'sample_id')}) b USING (fold_id, fold_side)""")
def c14(spark, sf):
    """Fold fingerprints against a recorded table of which two groups differ."""
    keys = ["fold_id", "fold_side"]
    path = scratch_path(spark, "fold-fingerprints")
    rows = members(spark, sf)
    gone = ((F.col("fold_id") == "fold_1") & (F.hour("target_timestamp") == 11)) | ((F.col("fold_id") == "fold_2") & (F.col("fold_side") == "eval"))
    Q.fingerprint(rows.filter(~gone), keys, F.col("sample_id")).write.parquet(path)
    again = Q.fingerprint(rows, keys, F.col("sample_id"))
    rec = spark.read.parquet(path).withColumnsRenamed({"n_ids": "_n", "hash_sum": "_s", "hash_xor": "_x"})
    same = (F.col("n_ids") == F.col("_n")) & (F.col("hash_sum") == F.col("_s")) & (F.col("hash_xor") == F.col("_x"))
    return again.join(rec, keys, "full_outer").select(*keys, F.coalesce(same, F.lit(False)).alias("identical"))


cte("recorded_counts", """SELECT ticker, n FROM (SELECT ticker, count(*) AS n FROM events_train WHERE hour(target_timestamp) <> 11 OR ticker <> 'click' GROUP BY 1) WHERE ticker <> 'view' UNION ALL SELECT 'absent', 1""")


@query("c15_count_parity", """SELECT ticker, a.n::BIGINT AS rebuilt, b.n::BIGINT AS recorded, coalesce(a.n = b.n, false) AS identical FROM (SELECT ticker, count(*) AS n FROM events_train GROUP BY 1) a FULL JOIN recorded_counts b USING (ticker)""")
def c15(spark, sf):
    """Per-ticker counts against the JSON map of a recorded profile (one entry per ticker): one count is short, one entry missing, one unknown."""
    events = train_events(spark, sf)
    per = events.groupBy("ticker").agg(F.count("*").alias("rebuilt"))
    kept = events.filter((F.hour("target_timestamp") != 11) | (F.col("ticker") != "click")).filter("ticker <> 'view'").groupBy("ticker").agg(F.count("*").alias("n"))
    kept = kept.unionByName(spark.createDataFrame([("absent", 1)], "ticker string, n long"))
    record = kept.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ticker", "n")))).alias("j"))
    rec = record.select(F.explode(F.from_json("j", "map<string,bigint>")).alias("ticker", "recorded"))
    return per.join(rec, "ticker", "full_outer").withColumn("identical", F.coalesce(F.col("rebuilt") == F.col("recorded"), F.lit(False)))


@query("q1_union_of_frames", """SELECT source, count(*)::BIGINT AS n, sum(y_pred)::BIGINT AS n_up FROM (SELECT 'model' AS source, y_pred FROM scored_one UNION ALL SELECT 'baseline', base_pred FROM scored_one) GROUP BY 1""")
def q1(spark, sf):
    a = P.scored(spark, sf).select(F.lit("model").alias("source"), "y_pred")
    b = P.baseline_dump(spark, sf).select("y_pred", F.lit("baseline").alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.sum("y_pred").alias("n_up"))


@query("q2_distinct_days", """SELECT ticker, count(DISTINCT trading_day)::BIGINT AS n_days FROM facts GROUP BY 1""")
def q2(spark, sf):
    return P.facts(spark, sf).select("ticker", "trading_day").distinct().groupBy("ticker").agg(F.count("*").alias("n_days"))


@query("q3_canonical_sort", """SELECT sample_id, ticker, target_timestamp, label FROM events_train ORDER BY target_timestamp, ticker, sample_id""")
def q3(spark, sf):
    return train_events(spark, sf).select("sample_id", "ticker", "target_timestamp", "label").orderBy("target_timestamp", "ticker", "sample_id")


@query("a3_file_integrity")
def a3(spark, sf):
    """Files of the data folder, by plain sha256, against a recorded manifest with planted faults: a changed digest, another size, a file that is gone and one that was not recorded."""
    path = scratch_path(spark, "manifest")
    found = materialise(Q.file_inventory(spark, f"{sf}/*.parquet", sequential=True), "inventory")
    name = F.col("relative_path")
    bad = found.filter(name != "supplier.parquet").withColumns({
        "sha256": F.when(name == "nation.parquet", F.reverse("sha256")).otherwise(F.col("sha256")), "bytes": F.when(name == "region.parquet", F.col("bytes") + 1).otherwise(F.col("bytes")),
        "relative_path": F.when(name == "part.parquet", "gone.parquet").otherwise(name)})
    bad.write.parquet(path)
    return Q.verify_manifest(found, spark.read.parquet(path)).select("relative_path", "bytes", "sha256", "status")


@query("a9_artifact_inventory")
def a9(spark, sf):
    """A written table's files inventoried and required back, strictly."""
    out = scratch_path(spark, "artifact")
    L.event_index(labelled(spark, sf)).write.parquet(out)
    inv = scratch_path(spark, "artifact-inventory")
    Q.file_inventory(spark, f"{out}/*.parquet").write.parquet(inv)
    v = Q.require_inventory(Q.verify_manifest(Q.file_inventory(spark, f"{out}/*.parquet"), spark.read.parquet(inv)), strict=True)
    return Q.completeness(v)


@query("a10_run_inventory", """SELECT o_orderkey AS run_id, CASE WHEN l_orderkey IS NULL THEN 'pending' ELSE l_linenumber || '|' || l_partkey || '|' || l_suppkey END AS artifact,
  CASE WHEN l_orderkey IS NULL THEN 'pending' WHEN l_returnflag = 'N' THEN 'missing_in_inventory' ELSE 'recorded' END AS status
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def a10(spark, sf):
    """Orders as runs, line items as artifacts; a run without any keeps a pending row."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey").alias("artifact"),
        F.when(F.col("l_returnflag") != "N", F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256)).alias("sha256"))
    return Q.run_inventory(runs, li, "run_id").select("run_id", "artifact", "status")


# ---- selection rules -------------------------------------------------------------------

@query("p1_candidate_selection", """WITH s AS (SELECT *, median_mean_delta > 0 AND positive_ticker_count >= 3 AND positive_family_count >= 1 AS ok FROM screening),
  k AS (SELECT *, row_number() OVER (ORDER BY ok DESC, median_family_lcb DESC, min_family_lcb DESC, best_family_lcb DESC, median_mean_delta DESC, n_samples_total DESC, candidate_id) AS rk FROM s)
  SELECT candidate_id, ok AND rk <= 1 AS selected_for_stage02, CASE WHEN NOT bool_or(ok) OVER () THEN 'failed_stage02_eligibility_rule' WHEN ok AND rk <= 1 THEN 'selected_train_inner_probe_signal' ELSE 'screened_not_selected' END AS selection_reason FROM k""")
def p1(spark, sf):
    return DE.select_candidates(RO.candidate_screening(ledger(spark, sf)), top=1)


@query("p2_best_family", f"""SELECT candidate_id, arg_max(model_family, row(lcb_delta, mean_delta, model_family)) AS best_family, {r('arg_max(lcb_delta, row(lcb_delta, mean_delta, model_family))')} AS lcb_delta FROM famstat GROUP BY 1""")
def p2(spark, sf):
    c = ledger(spark, sf).filter("fit_status = 'completed'")
    fam = RS.metric_lcb(c, ["candidate_id", "model_family"], "delta_vs_dummy").withColumnsRenamed({"lcb": "lcb_delta", "mean": "mean_delta"})
    return rounded(DE.best_family(fam, ["candidate_id"]))


_ORD = "lcb_delta_vs_dummy DESC NULLS LAST, mean_delta_vs_dummy DESC NULLS LAST, mean_macro_f1 DESC NULLS LAST, min_positive_ticker_count DESC NULLS LAST, candidate_id, model_family, hpo_profile_id"
cte("elig", f"""SELECT *, row_number() OVER (ORDER BY {_ORD}) AS rk, row_number() OVER (PARTITION BY candidate_id ORDER BY {_ORD}) = 1 AS head FROM hpo
  WHERE completed_rows = expected_rows AND mean_delta_vs_dummy > 0 AND mean_delta_vs_majority > 0 AND min_positive_ticker_count >= 1""")
cte("picks", """WITH p AS (SELECT * FROM elig WHERE rk = 1), f AS (SELECT e.* FROM elig e, p WHERE e.rk > 1 AND e.model_family <> p.model_family ORDER BY e.head DESC, e.rk LIMIT 1)
  SELECT 'primary' AS selected_role, * FROM p UNION ALL SELECT 'fallback', * FROM f""")
_HO = ["lcb_delta_vs_dummy", "mean_delta_vs_dummy", "mean_macro_f1"]


def picks(spark, sf):
    return DE.primary_and_fallback(RO.hpo_summary(ledger(spark, sf)), min_tickers=1, family_cap=1)


@query("p3_primary_and_fallback", f"""SELECT selected_role, candidate_id, model_family, hpo_profile_id, {', '.join(f'{r(c)} AS {c}' for c in _HO)}, min_positive_ticker_count FROM picks""")
def p3(spark, sf):
    return rounded(picks(spark, sf))


# Ledgers of the gate's cases: as it is, without rows, with a failed trial (and the same where that is allowed), below both baselines, and of one profile.
_CASES = ("as_is", "empty", "failed_trial", "failed_trial_allowed", "nothing_eligible", "one_profile")
cte("gate_ledger", """SELECT v.c, l.* REPLACE (CASE WHEN v.c LIKE 'failed_trial%' AND seed = 202 AND fold_id = 'wf_1996' AND model_family = (SELECT min(model_family) FROM picks WHERE selected_role = 'primary') THEN 'failed' ELSE fit_status END AS fit_status,
    CASE WHEN v.c = 'nothing_eligible' THEN -abs(delta_vs_dummy) ELSE delta_vs_dummy END AS delta_vs_dummy)
  FROM ledger l, (SELECT unnest(['as_is', 'empty', 'failed_trial', 'failed_trial_allowed', 'nothing_eligible', 'one_profile']) AS c) v WHERE v.c <> 'empty'
    AND (v.c <> 'one_profile' OR (l.candidate_id, l.model_family, l.hpo_profile_id) IN (SELECT candidate_id, model_family, hpo_profile_id FROM picks WHERE selected_role = 'primary'))""")
cte("gate_summary", f"""SELECT c, candidate_id, model_family, hpo_profile_id, count(*) AS expected, count_if(fit_status = 'completed') AS done, avg(delta_vs_dummy) FILTER (fit_status = 'completed') AS md, avg(delta_vs_majority) FILTER (fit_status = 'completed') AS mm,
    avg(macro_f1) FILTER (fit_status = 'completed') AS mf, min(positive_ticker_count) FILTER (fit_status = 'completed') AS mt, {lcb("CASE WHEN fit_status = 'completed' THEN delta_vs_dummy END")} AS lo FROM gate_ledger GROUP BY 1, 2, 3, 4""")
cte("gate_ranked", """SELECT *, row_number() OVER (PARTITION BY c ORDER BY lo DESC NULLS LAST, md DESC NULLS LAST, mf DESC NULLS LAST, mt DESC NULLS LAST, candidate_id, model_family, hpo_profile_id) AS rk FROM gate_summary WHERE expected = done AND md > 0 AND mm > 0 AND mt >= 1""")
cte("gate_first", "SELECT * FROM gate_ranked WHERE rk = 1")
cte("gate_second", """SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.c ORDER BY CASE WHEN r.rk = w.rk THEN 0 ELSE 1 END, r.rk) AS o FROM gate_ranked r JOIN gate_first f ON f.c = r.c AND f.model_family <> r.model_family
    JOIN (SELECT c, candidate_id, min(rk) AS rk FROM gate_ranked GROUP BY 1, 2) w ON w.c = r.c AND w.candidate_id = r.candidate_id WHERE r.rk > 1) WHERE o = 1""")


@query("p3_selection_bundle", f"""WITH z AS (SELECT v.c, (SELECT count(*) FROM gate_summary s WHERE s.c = v.c) AS n, (SELECT count(*) FROM gate_ledger l WHERE l.c = v.c AND fit_status <> 'completed') AS open_trials,
    (SELECT count(*) FROM gate_ranked r WHERE r.c = v.c) AS able, f.candidate_id || '|' || f.model_family || '|' || f.hpo_profile_id AS p, s.candidate_id || '|' || s.model_family || '|' || s.hpo_profile_id AS b
    FROM (SELECT unnest({list(_CASES)}) AS c) v LEFT JOIN gate_first f ON f.c = v.c LEFT JOIN gate_second s ON s.c = v.c),
  k AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN open_trials > 0 AND c <> 'failed_trial_allowed' THEN 2 WHEN able = 0 THEN 3 WHEN p IS NULL OR b IS NULL THEN 4 ELSE 5 END AS g FROM z)
  SELECT c AS case_id, g = 5 AS ready_for_next_stage, {[d for d, _ in DE.GATE] + [DE.READY]}[g] AS decision, {[x for _, x in DE.GATE] + ['']}[g] AS block_reason, CASE WHEN g > 3 THEN p END AS primary, CASE WHEN g > 3 THEN b END AS fallback FROM k""")
def p3b(spark, sf):
    """The gate on the ledger as it is and on one ledger for each way to be blocked."""
    led = materialise(ledger(spark, sf), "ledger")
    first = DE.primary_and_fallback(RO.hpo_summary(led), 1, 1).filter("selected_role = 'primary'").select(*DE.HPO_KEYS)
    family = first.select(F.col("model_family").alias("_f"))
    hit = (F.col("seed") == 202) & (F.col("fold_id") == "wf_1996") & (F.col("model_family") == F.col("_f"))
    failed = led.crossJoin(F.broadcast(family)).withColumn("fit_status", F.when(hit, "failed").otherwise(F.col("fit_status"))).drop("_f")  # one row
    cases = {"as_is": led, "empty": led.limit(0), "failed_trial": failed, "failed_trial_allowed": failed,
             "nothing_eligible": led.withColumn("delta_vs_dummy", -F.abs("delta_vs_dummy")), "one_profile": led.join(F.broadcast(first), DE.HPO_KEYS, "left_semi")}
    out = None
    for name in _CASES:
        row = DE.selection_bundle(RO.hpo_summary(cases[name]), cases[name], 1, 1, name != "failed_trial_allowed").withColumn("case_id", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("p4_best_profile_per_family", f"""SELECT candidate_id, model_family, hpo_profile_id, {', '.join(f'{r(c)} AS {c}' for c in _HO)} FROM (SELECT *, row_number() OVER (PARTITION BY model_family
  ORDER BY lcb_delta_vs_dummy DESC NULLS LAST, mean_delta_vs_dummy DESC NULLS LAST, mean_macro_f1 DESC NULLS LAST, candidate_id, hpo_profile_id) AS rk FROM hpo) WHERE rk = 1""")
def p4(spark, sf):
    return rounded(DE.best_profile_per_family(RO.hpo_summary(ledger(spark, sf))).select("candidate_id", "model_family", "hpo_profile_id", *_HO))


@query("p5_mark_selected", """SELECT l.candidate_id, l.model_family, l.hpo_profile_id, l.fold_id, l.seed, coalesce(p.selected_role, '') AS selected_role FROM ledger l
  LEFT JOIN picks p ON p.candidate_id = l.candidate_id AND p.model_family = l.model_family AND p.hpo_profile_id = l.hpo_profile_id""")
def p5(spark, sf):
    led = ledger(spark, sf)
    return DE.mark_selected(led, DE.primary_and_fallback(RO.hpo_summary(led), 1, 1)).select("candidate_id", "model_family", "hpo_profile_id", "fold_id", "seed", "selected_role")


@query("p6_validation_criteria", f"""WITH mj AS (SELECT CASE WHEN avg(y_true) > 0.5 THEN 1 ELSE 0 END AS maj FROM facts WHERE yr < 1996),
  s AS (SELECT seed, {f1()} AS f, {delta()} AS d, {f1()} - CASE WHEN maj = 1 THEN {cf1(1)} ELSE {cf1(0)} END AS m FROM (SELECT seed, {RESUM_SQL} FROM cells_one GROUP BY 1), mj),
  t AS (SELECT count_if(x > 0) AS pt FROM (SELECT ticker, avg(d) AS x FROM (SELECT ticker, seed, {delta()} AS d FROM (SELECT ticker, seed, {RESUM_SQL} FROM cells_one GROUP BY 1, 2)) GROUP BY 1)),
  a AS (SELECT count(*)::BIGINT AS n, avg(f) AS f, avg(d) AS d, avg(m) AS m FROM s)
  SELECT n AS n_completed_seeds, {r('f')} AS mean_macro_f1, {r('d')} AS mean_delta_vs_dummy, {r('m')} AS mean_delta_vs_majority, pt::BIGINT AS positive_ticker_count, d > 0 AS delta_vs_stratified_dummy_met,
  m > 0 AS delta_vs_majority_met, pt >= 3 AS ticker_floor_met, CASE WHEN d > 0 AND m > 0 AND pt >= 3 THEN 'met_predeclared_validation_readout_criteria' ELSE 'did_not_meet_predeclared_validation_readout_criteria' END AS decision FROM a, t""")
def p6(spark, sf):
    c = cells(spark, sf)
    g = c.groupBy("seed").agg(*C.resum()).crossJoin(F.broadcast(SL.majority_class(spark, sf)))  # one row
    per_seed = g.select("seed", C.macro_f1().alias("macro_f1"), C.delta_f1().alias("delta_vs_dummy"), (C.macro_f1() - C.constant_f1(F.col("majority_class"))).alias("delta_vs_majority"))
    return rounded(DE.validation_criteria(per_seed, RO.deltas(c, ["ticker", "seed"])))


@query("p7_walkforward_criteria", f"""SELECT positive_period_count, {r('row_pooled_delta')} AS pooled_delta, 'row_pooled' AS pooled_delta_estimand, {r('row_pooled_delta')} AS row_pooled_delta, {r('equal_weight_delta')} AS equal_weight_delta,
  positive_period_count >= 2 AS positive_period_count_met, row_pooled_delta > 0 AS pooled_delta_met, CASE WHEN positive_period_count >= 2 AND row_pooled_delta > 0 THEN 'met_predeclared_guarded_stability_criteria'
  ELSE 'did_not_meet_predeclared_guarded_stability_criteria' END AS decision FROM m6_rows JOIN m7_rows USING (model_family) WHERE model_family = '{P.PRIMARY}'""")
def p7(spark, sf):
    c = cells(spark, sf)
    return rounded(DE.walkforward_criteria(SL.row_pooled(c, []), SL.equal_weight(c, [])))


@query("p9_null_band", f"""SELECT count(*)::BIGINT AS n_rows, count(*) = 36 AND bool_and(fit_status = 'completed') AS complete, CASE WHEN count(*) = 36 AND bool_and(fit_status = 'completed') THEN {r('max(abs(delta_vs_dummy))')} END AS max_abs_delta,
  {r('avg(delta_vs_dummy)')} AS mean_delta FROM ledger WHERE candidate_id = 'set_O' AND model_family = 'logit'""")
def p9(spark, sf):
    where = (F.col("candidate_id") == "set_O") & (F.col("model_family") == "logit")
    return rounded(DE.null_band(ledger(spark, sf), where, 36))


cte("cell_trials", f"""SELECT horizon_k, no_trade_band_bps, fold_id, seed, CASE WHEN p = 0 OR p = n THEN 'failed' ELSE 'completed' END AS fit_status, {delta()} AS delta_vs_dummy, {bf1()} AS dummy_macro_f1 FROM
  (SELECT c.horizon_k, c.no_trade_band_bps, 'wk_' || (day(c.trading_day::DATE) // 7) AS fold_id, s.seed, count(*)::BIGINT AS n, sum(c.label)::BIGINT AS p, sum(fo)::BIGINT AS pp, sum(c.label * fo)::BIGINT AS tp,
    sum(co)::BIGINT AS bp, sum(c.label * co)::BIGINT AS btp FROM (SELECT c.*, CASE WHEN coalesce(f.log_return, 0) > 0 THEN 1 ELSE 0 END AS fo FROM cell_labels c
      JOIN features f ON f.ticker || '|' || strftime(f."timestamp", '%Y-%m-%dT%H:%M:%S') = c.sample_id WHERE c.valid_label) c, seeds s, LATERAL (SELECT CASE WHEN {h01("'coin|' || s.seed || '|' || c.sample_id")} < 0.5::DOUBLE THEN 1 ELSE 0 END AS co)
   GROUP BY 1, 2, 3, 4)""")
cte("cell_agg", """SELECT horizon_k, no_trade_band_bps, count(*) AS expected_rows, count_if(fit_status = 'completed') AS completed_rows, avg(CASE WHEN fit_status = 'completed' THEN delta_vs_dummy END) AS mean_delta FROM cell_trials GROUP BY 1, 2""")


def cell_trials(spark, sf):
    from ..functions.scalar import hash01
    lab = train_cells(spark, sf).filter("valid_label").select("horizon_k", "no_trade_band_bps", "ticker", "trading_day", "timestamp", "sample_id", F.col("label").alias("y_true"))
    x = lab.join(featured(spark, sf).select("ticker", "trading_day", "timestamp", "log_return"), ["ticker", "trading_day", "timestamp"])
    x = x.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in P.SEEDS]))).withColumns({
        "y_pred": F.when(F.coalesce(F.col("log_return"), F.lit(0.0)) > 0, 1).otherwise(0),
        "base_pred": F.when(hash01("coin", F.col("seed"), F.col("sample_id")) < 0.5, 1).otherwise(0),
        "fold_id": F.concat(F.lit("wk_"), F.floor(F.dayofmonth(F.to_date("trading_day")) / 7))})
    keys = ["horizon_k", "no_trade_band_bps", "fold_id", "seed"]
    g = x.groupBy(*keys).agg(*C.row_sums())
    one = (F.col("p") == 0) | (F.col("p") == F.col("n"))
    return g.select(*keys, F.when(one, "failed").otherwise("completed").alias("fit_status"), C.delta_f1().alias("delta_vs_dummy"),
                    C.base_f1().alias("dummy_macro_f1"), F.lit(None).cast("long").alias("positive_ticker_count"))


@query("f3_cell_trial_aggregates", f"""SELECT horizon_k, no_trade_band_bps, expected_rows::BIGINT AS expected_rows, completed_rows::BIGINT AS completed_rows, {r('mean_delta')} AS mean_delta FROM cell_agg""")
def f3t(spark, sf):
    a = RO.group_aggregates(cell_trials(spark, sf), ["horizon_k", "no_trade_band_bps"])
    return rounded(a.select("horizon_k", "no_trade_band_bps", "expected_rows", "completed_rows", "mean_delta"))


@query("p10_band_horizon_reading", f"""WITH c AS (SELECT *, CASE WHEN mean_delta > 0 THEN 'positive' WHEN mean_delta < 0 THEN 'negative' WHEN mean_delta = 0 THEN 'zero' ELSE 'undefined' END AS s FROM cell_agg),
  g AS (SELECT bool_or(completed_rows < expected_rows) AS inc, bool_and(s IN ('positive', 'negative')) FILTER (horizon_k = 2) AS bd, bool_and(s IN ('positive', 'negative')) FILTER (no_trade_band_bps = 500) AS hd,
    count(DISTINCT s) FILTER (horizon_k = 2) = 1 AS b1, count(DISTINCT s) FILTER (no_trade_band_bps = 500) = 1 AS h1 FROM c)
  SELECT bd AND b1 AS band_axis_sign_stable, hd AND h1 AS horizon_axis_sign_stable, CASE WHEN inc THEN 'incomplete_run_fix_and_rerun' WHEN NOT bd OR NOT hd THEN 'sign_undefined_on_an_axis_reported_descriptively'
    WHEN bd AND b1 AND hd AND h1 THEN 'not_knife_edge_sign_stable_both_axes' WHEN NOT (bd AND b1) AND NOT (hd AND h1) THEN 'sign_flip_on_both_axes_limitation_strengthened'
    WHEN NOT (bd AND b1) THEN 'sign_flip_on_band_axis_limitation_strengthened' ELSE 'sign_flip_on_horizon_axis_limitation_strengthened' END AS overall_outcome FROM g""")
def p10(spark, sf):
    return DE.band_horizon_reading(RO.group_aggregates(cell_trials(spark, sf), ["horizon_k", "no_trade_band_bps"]), TP.HORIZON_K, TP.BAND_BPS)


cte("emb_trials", f"""SELECT variant_id, seed, period_id AS fold_id, {delta()} AS d FROM (SELECT v.variant_id, seed, period_id, {RESUM_SQL} FROM (SELECT *, min(trading_day) OVER (PARTITION BY period_id) AS first_day FROM cells_one),
  (SELECT unnest(['no_embargo', 'embargo_1day']) AS variant_id) v WHERE variant_id = 'no_embargo' OR trading_day <> first_day GROUP BY 1, 2, 3)""")
cte("emb_seed", """SELECT seed, avg(d) FILTER (variant_id = 'no_embargo') AS b, avg(d) FILTER (variant_id = 'embargo_1day') AS e, count_if(variant_id = 'no_embargo')::BIGINT AS nb, count_if(variant_id = 'embargo_1day')::BIGINT AS ne FROM emb_trials GROUP BY 1""")


def embargo_trials(spark, sf):
    """One set of predictions scored with and without each period's first evaluation day."""
    c = cells(spark, sf)
    first = c.groupBy("period_id").agg(F.min("trading_day").alias("_first"))  # one row per period
    v = c.join(F.broadcast(first), "period_id").withColumn("variant_id", F.explode(F.array_compact(F.array(
        F.lit("no_embargo"), F.when(F.col("trading_day") != F.col("_first"), "embargo_1day")))))
    g = v.groupBy("variant_id", "seed", "period_id").agg(*C.resum())
    return g.select("variant_id", "seed", F.col("period_id").alias("fold_id"), F.lit("completed").alias("fit_status"), C.delta_f1().alias("delta_vs_dummy"))


@query("g19_embargo_trials", f"""SELECT variant_id, seed, fold_id, 'completed' AS fit_status, {r('d')} AS delta_vs_dummy FROM emb_trials""")
def g19(spark, sf):
    return rounded(embargo_trials(spark, sf))


@query("p11_embargo_per_seed", f"""SELECT seed, {r('b')} AS no_embargo_margin, nb AS no_embargo_expected_rows, nb AS no_embargo_completed_rows, {r('e')} AS embargo_1day_margin, ne AS embargo_1day_expected_rows, ne AS embargo_1day_completed_rows,
  coalesce(b > 0, false) AS rule_applicable, CASE WHEN b > 0 THEN {r('e / b')} END AS retained_margin_fraction, CASE WHEN b > 0 THEN e < 0.5 * b END AS materially_smaller FROM emb_seed""")
def p11(spark, sf):
    return rounded(DE.embargo_reading(embargo_trials(spark, sf))[0])


@query("p11_embargo_reading", """SELECT CASE WHEN NOT bool_and(b > 0) THEN 'baseline_margin_not_positive_rule_inapplicable' WHEN bool_and(e < 0.5 * b) THEN 'materially_smaller_cross_day_dependence_inflation_reported'
  WHEN NOT bool_or(e < 0.5 * b) THEN 'roughly_unchanged_limitation_bounded_not_removed' ELSE 'mixed_across_seeds_inconclusive' END AS overall_outcome FROM emb_seed""")
def p11r(spark, sf):
    return DE.embargo_reading(embargo_trials(spark, sf))[1]


# ---- bands and autopsy -----------------------------------------------------------------

BAND_BOOT = 1000
cte("band_days", "SELECT DISTINCT trading_day FROM ranked")
boot_sql("band", "band_days", [], BAND_BOOT, [], "trading_day")
# Every draw's rows in rank order with the running covered rows and errors: the plain definition.
cte("band_runs", """SELECT draw, seed, c, wrong, sum(c) OVER w AS cc, sum(c * wrong) OVER w AS ee, sum(c) OVER (PARTITION BY draw, seed) AS cn
  FROM (SELECT r.seed, r.rk, i.idx AS p, 1 - r.correct AS wrong FROM ranked r JOIN band_idx i USING (trading_day)) r JOIN band_h0 USING (p) WINDOW w AS (PARTITION BY draw, seed ORDER BY rk)""", True)
cte("band_totals", """SELECT draw, seed, max(cn) AS n, max(ee) AS e, sum(list_sum(list_transform(range(1, c::BIGINT + 1), lambda j: (ee - c * wrong + wrong * j)::DOUBLE / (cc - c + j)::DOUBLE))) / max(cn) AS aurc FROM band_runs GROUP BY 1, 2""", True)
cte("band_steps", """SELECT draw, seed, (cc - c)::DOUBLE / cn AS x0, cc::DOUBLE / cn AS x1, CASE WHEN cc = c THEN ee::DOUBLE / cc ELSE (ee - c * wrong)::DOUBLE / (cc - c) END AS y0, ee::DOUBLE / cc AS y1, cc = cn AS ends
  FROM band_runs WHERE cc = cn OR floor(((cc - c)::DOUBLE / cn - 0.05) / 0.005 - 1e-6) <> floor((cc::DOUBLE / cn - 0.05) / 0.005 + 1e-6)""")
cte("band_vals", """SELECT draw, i AS grid_index, avg(CASE WHEN g >= x1 THEN y1 WHEN g = x0 THEN y0 ELSE (y1 - y0) / (x1 - x0) * (g - x0) + y0 END) AS risk
  FROM band_steps, (SELECT i, 0.05::DOUBLE + i * 0.005::DOUBLE AS g FROM (SELECT unnest(range(191)) AS i)) WHERE g >= x0 AND (g < x1 OR ends) GROUP BY 1, 2""")
cte("band_full", "SELECT draw, avg(e::DOUBLE / n) AS f FROM band_totals GROUP BY 1")
cte("band_scalars", """SELECT draw, avg(aurc) AS a, avg(e::DOUBLE / n) AS f, avg((e - (n - e) * list_sum(list_transform(range((n - e)::BIGINT + 1, n::BIGINT + 1), lambda k: 1 / k::DOUBLE))) / n) AS o FROM band_totals GROUP BY 1""")


def day_ranked(spark, sf):
    from ..operators.ranks import confidence_rank
    return confidence_rank(SEL.with_confidence(stored(spark, sf, None, "seed", "trading_day", "sample_id", "y_true", "y_pred", "p_up"), ["seed", "trading_day"]), ["seed"], keep_tie=False)


def resampled(spark, sf):
    return SEL.resampled_curves(day_ranked(spark, sf), BAND_BOOT, BOOT_SEED)


@query("i10_bootstrap_bands", f"""SELECT grid_index, {r('quantile_cont(risk, 0.025)', 7)} AS risk_lo, {r('quantile_cont(risk, 0.975)', 7)} AS risk_hi, {r('avg(risk)', 7)} AS risk_mean,
  {r('quantile_cont((f - risk) * 100, 0.025)', 7)} AS delta_lo, {r('quantile_cont((f - risk) * 100, 0.975)', 7)} AS delta_hi FROM band_vals JOIN band_full USING (draw) GROUP BY 1""")
def i10(spark, sf):
    return rounded(SEL.bootstrap_bands(*resampled(spark, sf)), 7)


@query("i10_scalar_intervals", f"""SELECT statistic, {r('quantile_cont(x, 0.025)', 7)} AS lo, {r('quantile_cont(x, 0.975)', 7)} AS hi, count(*)::BIGINT AS n_draws FROM
  (SELECT unnest(['aurc', 'delta', 'e_aurc', 'gap', 'rel']) AS statistic, unnest([a, a - f, a - o, (f - a) / (f - o), (a - o) / (f - o)]) AS x FROM band_scalars) GROUP BY 1""")
def i10s(spark, sf):
    return rounded(SEL.scalar_intervals(resampled(spark, sf)[1]), 7)


@query("i11_random_order_band")
def i11(spark, sf):
    return rounded(SEL.permutation_band(SEL.with_confidence(P.scored(spark, sf), ["seed"]), BAND_BOOT, PERM_SEED))


cte("terc_blocks", """SELECT b.*, unnest(['all', t.activity_tercile]) AS activity_tercile FROM seed_blocks b JOIN day_terciles t USING (ticker, trading_day)""")
boot_sql("i12", "terc_blocks", ["activity_tercile", "seed"], N_BOOT, SIX)
cte("terc_ranked", """SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY activity_tercile, seed) AS nn, sum(correct) OVER (w ROWS UNBOUNDED PRECEDING) AS cc, sum(correct) OVER (PARTITION BY activity_tercile, seed) AS tot
  FROM (SELECT s.seed, s.sample_id, greatest(p_up, 1 - p_up) AS confidence, (y_true = y_pred)::INTEGER AS correct, unnest(['all', t.activity_tercile]) AS activity_tercile FROM scored_one s JOIN day_terciles t USING (ticker, trading_day))
  WINDOW w AS (PARTITION BY activity_tercile, seed ORDER BY confidence DESC, sample_id)""")
cte("autopsy_per", f"""SELECT activity_tercile, seed::VARCHAR AS seed, n_rows, macro_f1, accuracy, aurc, e_aurc, augrc, full_coverage_risk, d AS delta_vs_dummy, d - l AS mde_vs_dummy, l > 0 AS delta_clears_mde FROM
  (SELECT activity_tercile, seed, count(*)::BIGINT AS n_rows, avg(1 - cc::DOUBLE / rk) AS aurc, avg(1 - cc::DOUBLE / rk) - avg(1 - least(rk, tot)::DOUBLE / rk) AS e_aurc, avg((1 - cc::DOUBLE / rk) * rk / nn) AS augrc,
    1 - max(tot)::DOUBLE / count(*) AS full_coverage_risk FROM terc_ranked GROUP BY 1, 2)
  JOIN (SELECT activity_tercile, seed, {f1()} AS macro_f1, (n - p - pp + 2 * tp)::DOUBLE / n AS accuracy, {delta()} AS d FROM terc_seed) USING (activity_tercile, seed)
  JOIN (SELECT activity_tercile, seed, quantile_cont(x, 0.025) AS l FROM (SELECT activity_tercile, seed, {delta()} AS x FROM i12_draws) GROUP BY 1, 2) USING (activity_tercile, seed)""")
_I12 = ["macro_f1", "accuracy", "aurc", "e_aurc", "augrc", "full_coverage_risk", "delta_vs_dummy", "mde_vs_dummy"]


@query("i12_selective_autopsy", f"""SELECT activity_tercile, seed, n_rows, {', '.join(f'{r(c)} AS {c}' for c in _I12)}, delta_clears_mde FROM autopsy_per
  UNION ALL SELECT activity_tercile, 'seed_mean', round(avg(n_rows))::BIGINT, {', '.join(r(f'avg({c})') for c in _I12)}, avg(delta_vs_dummy) > avg(mde_vs_dummy) FROM autopsy_per GROUP BY 1""")
def i12(spark, sf):
    rows = stored(spark, sf)
    blocks = materialise(RO.block_cells(rows, ["seed"]), "blocks")
    return rounded(SEL.selective_autopsy(rows, SL.activity_terciles(rows), blocks, N_BOOT, BOOT_SEED))


# ---- text ------------------------------------------------------------------------------

# Configured lists of these checks.
FORBIDDEN = ["all rights reserved", "MIT License", "apache", "copyright", "confidential"]
NEGATORS = ["not ", "is ", "never "]
LEXICON = ["license", "the of", "and the"]
FLOORS = {"licence": (["license", "License", "LICENSE"], 1), "article": (["The ", "Le "], 50), "rights": (["All rights", "all rights"], 3)}


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def _has(p):
    return f"contains(lower(text), '{p.lower()}')"


@query("r1_phrase_hits", f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_has(p)} THEN '{p}' END" for p in FORBIDDEN)}], lambda x: x IS NOT NULL), ',') AS phrases FROM documents WHERE {' OR '.join(_has(p) for p in FORBIDDEN)}""")
def r1(spark, sf):
    return TX.phrase_hits(docs(spark, sf), FORBIDDEN).withColumn("phrases", F.array_join("phrases", ","))


TERM = "the "
_win = f"regexp_replace(substr(text, greatest(0, pos - 60) + 1, least(60, pos)), '^.*[.;:]', '', 's')"


@query("r2_unnegated_terms", f"""WITH parts AS (SELECT doc_id, text, string_split(text, '{TERM}') AS ps FROM documents),
  occ AS (SELECT doc_id, text, i, sum(length(ps[i])) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {len(TERM)} AS pos, len(ps) AS np FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
  hit AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_win} AS w FROM (SELECT * REPLACE (pos::BIGINT AS pos) FROM occ WHERE i < np)) WHERE NOT ({' OR '.join(f"contains(w, '{n}')" for n in NEGATORS)}) GROUP BY 1)
  SELECT d.doc_id, coalesce(h.n, 0)::INTEGER AS n_unnegated FROM documents d LEFT JOIN hit h USING (doc_id)""")
def r2(spark, sf):
    return docs(spark, sf).select("doc_id", TX.unnegated_count(F.col("text"), TERM, NEGATORS).alias("n_unnegated"))


@query("r3_sentence_statistics", f"""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' '), '\\.\\s+', '.' || chr(1), 'g'), chr(1)),
    lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))) AS l FROM documents), k AS (SELECT *, list_filter(l, lambda n: n >= 3) AS kk FROM s)
  SELECT doc_id, len(l)::INTEGER AS n_sentences, len(list_filter(l, lambda n: n > 35))::INTEGER AS n_long, CASE WHEN len(kk) >= 6 THEN {r('list_stddev_pop(kk)', 6)} END AS length_std FROM k""")
def r3(spark, sf):
    return rounded(TX.sentence_statistics(docs(spark, sf)), 6)


@query("r4_number_inventory")
def r4(spark, sf):
    return TX.number_inventory(docs(spark, sf))


@query("r4_numbers_added")
def r4b(spark, sf):
    """Numbers the web pages hold beyond those of the documents, as a multiset."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return TX.tokens_added(TX.number_counts(docs(spark, sf)), TX.number_counts(pages))


def _norm(x):
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({x}, '\\\\[a-zA-Z]+', ' ', 'g'), '[{{}}\\\\$~]', ' ', 'g')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("r5_title_match", f"""WITH a AS (SELECT item_id AS left_id, {_norm("split_part(text, '.', 1)")} AS ta FROM benchmark), b AS (SELECT doc_id AS right_id, {_norm("split_part(text, '.', 1)")} AS tb FROM documents),
  p AS (SELECT *, list_distinct(string_split(ta, ' ')) AS wa, list_distinct(string_split(tb, ' ')) AS wb FROM a, b WHERE ta <> '' AND tb <> '')
  SELECT left_id, right_id FROM p WHERE contains(ta, tb) OR contains(tb, ta) OR len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) >= 0.6""")
def r5(spark, sf):
    """Benchmark titles (first sentence) against document titles."""
    first = F.split_part("text", F.lit("."), F.lit(1)).alias("title")
    left = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), first)
    right = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), first)
    return TX.title_pairs(left, right)


@query("r6_unanchored_paragraphs", f"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS para, generate_subscripts(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> ''), 1) AS paragraph FROM documents)
  SELECT doc_id, paragraph::INTEGER AS paragraph, len(list_filter(regexp_split_to_array(para, '\\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM p
  WHERE len(list_filter(regexp_split_to_array(para, '\\s+'), lambda w: w <> '')) >= 20 AND NOT regexp_matches(para, '\\d') AND NOT ({' OR '.join(f"contains(lower(para), '{x}')" for x in LEXICON)})""")
def r6(spark, sf):
    return TX.unanchored_paragraphs(docs(spark, sf), 20, LEXICON)


_flo = " UNION ALL ".join(
    f"SELECT source, '{n}' AS phrase_id, sum({' + '.join(f'''((length(text) - length(replace(text, '{v}', ''))) // {len(v)})''' for v in vs)})::BIGINT AS hits, {f} AS floor FROM documents GROUP BY 1" for n, (vs, f) in FLOORS.items())


@query("r7_phrase_floors", f"""SELECT *, CASE WHEN hits = 0 THEN 'floor_unbound' WHEN hits < floor THEN 'missing_required' ELSE 'met' END AS status FROM ({_flo})""")
def r7(spark, sf):
    return TX.phrase_floors(docs(spark, sf), "source", FLOORS)
