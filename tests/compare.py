"""Run registered queries against their SQL on the same Parquet: ``python tests/compare.py sf name...``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return ("rows", len(got), t1 - t0, 0.0, "")
    rel = con.sql(sql)
    want = rel.fetchall()
    t2 = time.time()
    msg = ""
    if sorted(df.columns) != sorted(rel.columns):
        msg = f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    else:
        a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            msg = f"rows {len(a)} vs {len(b)}; {len(diff)} first diffs {sorted(df.columns)} {diff}"
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
        want_t = dict(zip(rel.columns, map(str, rel.types)))
        bad = [(c, t, want_t[c]) for c, t in df.dtypes if kinds.get(t, want_t[c]) != want_t[c]]
        if bad:
            msg += f" types {bad}"
    return ("BAD" if msg else "ok", len(got), t1 - t0, t2 - t1, msg)


def main(argv):
    from sigmeter.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = argv[0] if argv else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv[1:]):
            continue
        try:
            status, n, a, b, msg = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the other queries
            status, n, a, b, msg = "ERR", -1, 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += status in ("BAD", "ERR")
        print(f"{status:5s} {name:42s} rows={n:<7d} spark={a:6.2f}s duck={b:6.2f}s {msg[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
