"""Run registered queries beside their SQL and compare values.

    python tests/check_sql.py [--sf DIR] [--threads N] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortline.runtime import local_session  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", float(f"{v:.9g}"))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, v if not isinstance(v, list) else tuple(map(_norm, v)))


def compare(columns_a, rows_a, columns_b, rows_b) -> str:
    """Empty when equal; else what differs first. Order of rows and columns does not count."""
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(set(columns_a) ^ set(columns_b))}"
    names = sorted(columns_a)

    def table(columns, rows):
        at = [list(columns).index(n) for n in names]
        return sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=repr)

    a, b = table(columns_a, rows_a), table(columns_b, rows_b)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return "; ".join(f"{n}: {p[-1]!r} ({p[0]}) != {q[-1]!r} ({q[0]})" for n, p, q in zip(names, x, y) if p != q)
    return ""


def check(spark, con, sf_dir: str, query, sql: str | None) -> tuple[str, int, float]:
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return "", len(rows), took
    cur = con.cursor().execute(sql)
    return compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()), len(rows), took


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--threads", type=int, default=4)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [k for k in queries if not args.names or any(k == n or k.startswith(n + "_") or
                                                          (n.endswith("*") and k.startswith(n[:-1])) for n in args.names)]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    failed, slow, empty = [], [], []

    def one(name):
        try:
            return name, *check(spark, con, args.sf, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            return name, f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0

    t0 = time.time()
    with ThreadPoolExecutor(args.threads) as pool:
        for name, problem, rows, took in pool.map(one, wanted):
            if problem:
                failed.append(name)
                print(f"FAIL {name}: {problem}", flush=True)
            if rows == 0:
                empty.append(name)
            slow.append((took, name))
    print(f"{len(wanted) - len(failed)}/{len(wanted)} equal in {time.time() - t0:.0f}s; without SQL: "
          f"{[k for k in wanted if k not in sqls]}; empty: {empty}")
    print("slowest:", [(round(s, 1), n) for s, n in sorted(slow, reverse=True)[:8]])
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
