"""Runs queries beside their SQL, as the driver does: rows, columns and order-free values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(d)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{d}/{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, d: str) -> str:
    """Empty if equal, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, d)
    got = rows_of(df.columns, df.collect())
    sql = e.oracle_sql().get(name)
    if sql is None:
        return ""
    cur = duck(d).execute(sql)
    columns = [x[0] for x in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows and {len(want)}; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    from tidemark.session import local_session

    import __spark_entry__ as e

    spark, d = local_session(), os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    bad = 0
    for name in sys.argv[1:] or e.queries():
        t = time.time()
        try:
            diff = compare(spark, name, d)
        except Exception as x:  # noqa: BLE001
            diff = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in e.oracle_sql() else '(no SQL)'} {diff}", flush=True)
    print("bad:", bad)
