"""Runs registered queries against their SQL in DuckDB and compares the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, con, name, fn, sql, sf):
    """(problem or None, rows, spark seconds)."""
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return None, len(got), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}", len(got), took
    a, b = ordered(df.columns, got), ordered(names, want)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} rows <> {len(b)} rows; first difference {diff}", len(got), took
    return None, len(got), took


def main():
    from zygospark.plans.queries import ORACLES, QUERIES
    from zygospark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, rows, took = check(spark, con, name, fn, ORACLES.get(name), sf)
        except Exception as e:  # noqa: BLE001
            problem, rows, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {rows:8d} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
