"""Compare registered queries with their SQL twins: ``python -m tests.oracle_check [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as E
from voxtally.session import ensure_checkpoint_dir, local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(name, spark, con, sf) -> str:
    start = time.time()
    df = E.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    sql = E.oracle_sql().get(name)
    if sql is None:
        return f"rows {name}: {len(got)} ({spent:.1f}s)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    duck_s = time.time() - start - spent
    if sorted(names) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"FAIL {name}: {len(got)} vs {len(want)} rows; {diff}"
    return f"ok   {name}: {len(got)} ({spent:.1f}s, sql {duck_s:.1f}s)"


def main(names):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    ensure_checkpoint_dir(spark)
    con = duck(sf)
    failed = []
    for name in names or list(E.queries()):
        try:
            line = compare(name, spark, con, sf)
        except Exception as e:  # report and go on to the next query
            line = f"FAIL {name}: {type(e).__name__} {str(e)[:900]}"
        print(line, flush=True)
        if line.startswith("FAIL"):
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
