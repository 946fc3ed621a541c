"""Compares every query with its SQL on one table folder: ``python tests/check_oracles.py [sf] [names...]``."""

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, True
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {df.columns} vs {cols}", t1 - t0, False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        lack = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {lack}", t1 - t0, False
    return f"ok {len(a)} rows, sql {time.time() - t1:.1f}s", t1 - t0, True


def main():
    import duckdb

    import __spark_entry__ as entry
    from crossweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            msg, sec, ok = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            msg, sec, ok = f"{type(e).__name__}: {str(e)[:600]}", 0.0, False
        print(f"{'PASS' if ok else 'FAIL'} {name:28s} {sec:6.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
