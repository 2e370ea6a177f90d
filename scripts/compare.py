"""Run registered queries beside their SQL and compare the rows.

    python scripts/compare.py [--sf DIR] [name ...]     names may end in '*'
"""

from __future__ import annotations

import argparse
import fnmatch
import functools
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from fieldglass.plans import catalog  # noqa: E402
from fieldglass.plans.registry import TABLES  # noqa: E402


print = functools.partial(print, flush=True)


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v) if v is not None else None


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    queries, oracles = catalog()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(fnmatch.fnmatch(name, p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}")
            continue
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.2f}s (no SQL) {df.columns}")
            continue
        try:
            res = con.execute(oracles[name])
            cols = [d[0] for d in res.description]
            want = res.fetchall()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:800]}")
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols):
            bad += 1
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(cols)}")
        elif a != b:
            bad += 1
            sa, sb = set(a), set(b)
            only_a = [x for x in a if x not in sb][:2]
            only_b = [x for x in b if x not in sa][:2]
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows\n   spark {[x[:600] for x in only_a]}\n   sql   {[x[:600] for x in only_b]}")
        else:
            print(f"ok   {name}: {len(a)} rows {took:.2f}s")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
