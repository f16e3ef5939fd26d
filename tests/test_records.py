"""Decision records by dotted path, printed texts, and digests in their recorded form."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigmeter.operators import integrity, readouts, records

PATHS = ["a.b", "a.c", "x", "a.b.c", "odd key"]


def test_record_fields_tell_null_from_missing(spark):
    rows = [(1, '{"a": {"b": 1.5, "c": null}, "x": [1, 2]}'), (2, '{"a": 7, "odd key": "v"}'), (3, "not json"), (4, None), (5, "{}")]
    got = {(r["id"], r["path"]): (r["value"], r["status"]) for r in
           records.record_fields(spark.createDataFrame(rows, "id long, record string"), ["id"], "record", PATHS).collect()}
    assert len(got) == len(rows) * len(PATHS)
    assert got[1, "a.b"] == ("1.5", "resolved") and got[1, "a.c"] == (None, "recorded_null") and got[1, "x"] == ("[1,2]", "resolved")
    assert got[1, "a.b.c"] == (None, "missing") and got[2, "a.b"] == (None, "missing") and got[2, "odd key"] == ("v", "resolved")
    assert {got[i, p] for i in (3, 4) for p in PATHS} == {(None, "no_record")} and got[5, "x"] == (None, "missing")


def test_resolve_ends_the_job_on_a_missing_key(spark):
    df = spark.createDataFrame([('{"a": {"b": null}}',)], "record string").select(F.parse_json("record").alias("v"))
    assert df.select(records.resolve(F.col("v"), "a.b")).first()[0] is None
    with pytest.raises(Exception, match="a.z"):
        df.select(records.resolve(F.col("v"), "a.z")).collect()


def test_recorded_digest_is_plain_sha256_of_the_joined_ids(spark):
    rows = [("hot", None, i * 7919 % 4001, f"id-{i}é") for i in range(4001)] + [("one", 1, 5, "x"), (None, 1, 1, "n2"), (None, 1, 0, "n1"), ("gap", 2, 0, None), ("gap", 2, 1, "z")]
    df = spark.createDataFrame(rows, "g string, h int, at long, id string").repartition(7)
    got = {(r["g"], r["h"]): (r["ids_sha256"], r["n_ids"]) for r in integrity.recorded_sha256(df, ["g", "h"], ["at"], F.col("id"), chunk_bytes=50).collect()}
    want = {}
    for g, h in {x[:2] for x in rows}:
        ids = [x[3] or "" for x in sorted((x for x in rows if x[:2] == (g, h)), key=lambda x: x[2])]
        want[g, h] = (hashlib.sha256("\n".join(ids).encode()).hexdigest(), len(ids))
    assert got == want
    assert got["one", 1][0] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"  # of the letter x
    assert integrity.recorded_sha256(df.limit(0), ["g", "h"], ["at"], F.col("id")).count() == 0


def test_text_audit_by_hand(spark):
    df = spark.createDataFrame([(2, " 2024-03-05 ", "run 12 of 9", 0.5), (1, "2024-03-04", "run 007 of 9", 0.25), (3, None, None, None)], "i int, day string, note string, x double")
    A = readouts.TextAudit
    specs = [A("d1", "date", "true", "day", "2024-03-04 to 2024-03-09"), A("d2", "date", "i = 2", "day", "on 2024-03-06"), A("d3", "date", "i = 3", "day", "2024-03-06"),
             A("n1", "regex_int", "true", "note", "all 7 runs", pattern=r"run (\d+)"), A("n2", "regex_int", "i > 1", "note", "all 7 runs", pattern=r"run (\d+)"),
             A("n3", "regex_int", "true", "note", "7", pattern=r"fold (\d+)"),
             A("r1", "range", "true", "x", "37 to 38.0", scale="100", digits=0, lo="37", hi="38"), A("r2", "range", "true", "x", "37 to 39", scale="100", lo="37", hi="38"),
             A("r3", "range", "true", "x", "1 to 2", how="max", lo="1", hi="2", digits=1), A("r4", "range", "i = 9", "x", "1 to 2", lo="1", hi="2")]
    got = {r["number_id"]: (r["derived_text"], r["derived"], r["status"]) for r in readouts.audit_texts(df, specs, ["i"]).collect()}
    assert got == {"d1": ("2024-03-04", None, "match"), "d2": ("2024-03-05", None, "mismatch"), "d3": (None, None, "unresolved"),
                   "n1": ("007", None, "match"), "n2": ("12", None, "mismatch"), "n3": (None, None, "unresolved"),
                   "r1": (None, 38.0, "match"), "r2": (None, 38.0, "review"), "r3": (None, 0.5, "review"), "r4": (None, None, "unresolved")}
    with pytest.raises(ValueError, match="mode"):
        readouts.audit_texts(df, [A("z", "other", "true", "x", "1")], ["i"])
