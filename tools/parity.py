"""Run registered queries on Spark and their checks on DuckDB and compare every row.

    python tools/parity.py [--sf DIR] [--only TEXT[,TEXT]] [--explain]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from onledger import catalog  # noqa: E402
from onledger.bindings import BASE  # noqa: E402


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def compare(left_cols, left, right_cols, right):
    if sorted(left_cols) != sorted(right_cols):
        return f"columns differ: {sorted(left_cols)} vs {sorted(right_cols)}"
    if len(left) != len(right):
        return f"rows differ: {len(left)} vs {len(right)}"
    names = sorted(left_cols)
    li, ri = [left_cols.index(c) for c in names], [right_cols.index(c) for c in names]

    def key(row):
        return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0)
                     for v in row)

    a = sorted((tuple(norm(r[i]) for i in li) for r in left), key=key)
    b = sorted((tuple(norm(r[i]) for i in ri) for r in right), key=key)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference:\n    spark {dict(zip(names, x))}\n    duck  {dict(zip(names, y))}"
        for n, p, q in zip(names, x, y):
            if type(p) is not type(q):
                return f"type of {n}: {type(p).__name__} vs {type(q).__name__}"
    return None


def session(cpus="8"):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("parity").config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="parity-"))
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--show", action="store_true")
    args = ap.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    wanted = [w for w in args.only.split(",") if w]
    bad = []
    for name, item in catalog.load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            df = catalog.run(item)(spark, args.sf)
            if args.explain:
                df.explain("formatted")
            rows = [tuple(r) for r in df.collect()]
            mid = time.time()
            if args.show:
                df.show(5, False)
            if item.check:
                cur = con.execute(item.check)
                cols = [d[0] for d in cur.description]
                other = cur.fetchall()
                problem = compare(df.columns, rows, cols, other)
            else:
                problem = None if rows else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            rows, mid = [], time.time()
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:44s} rows={len(rows):7d} spark={mid - begin:6.2f}s duck={time.time() - mid:6.2f}s"
              f"{'' if item.check else '  (rows only)'}", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
