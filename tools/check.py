"""Run registered queries against their SQL and report differences.

usage: python tools/check.py [--dir DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tickloom import plans  # noqa: E402
from tickloom.session import build_session  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(x):
    if x is None:
        return ("0", "")
    if isinstance(x, bool):
        return ("b", str(x))
    if isinstance(x, float):
        return ("f", "nan" if math.isnan(x) else repr(x + 0.0))
    if isinstance(x, (list, tuple)):
        return ("l", str([_norm(i) for i in x]))
    return (type(x).__name__, str(x))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(got_cols, got, want_cols, want) -> str:
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} vs {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; e.g.\n    {sorted(got_cols)}\n    {bad[0][0]}\n    {bad[0][1]}"
    return ""


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--limit", type=float, default=90, help="seconds before a query is given up")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    plans.load_all()
    names = [n for n in plans.QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    spark, con = build_session("check"), duck(a.dir)
    failed = 0
    for n in names:
        t0 = time.time()

        def give_up():
            print(f"SLOW  {n}: over {a.limit}s", flush=True)
            con.interrupt()
            spark.sparkContext.cancelAllJobs()

        timer = threading.Timer(a.limit, give_up)
        timer.start()
        try:
            df = plans.QUERIES[n](spark, a.dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if n not in plans.ORACLES:
                print(f"ROWS  {n:32s} {len(got):8d} rows  spark {t1 - t0:6.2f}s", flush=True)
                continue
            res = con.execute(plans.ORACLES[n])
            want_cols = [c[0] for c in res.description]
            want = res.fetchall()
            t2 = time.time()
            msg = compare(df.columns, got, want_cols, want)
            dup = "" if got else " EMPTY"
            print(f"{'FAIL ' if msg else 'ok   '} {n:32s} {len(got):8d} rows{dup}  spark {t1 - t0:6.2f}s  sql {t2 - t1:6.2f}s {msg}", flush=True)
            failed += bool(msg)
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
        finally:
            timer.cancel()
    print("failed", failed, "of", len(names))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
