"""Run registered queries on Spark and their DuckDB oracle side by side.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Prints one line per query: status, rows, seconds. Mirrors the driver's gate:
same column names, same row count, same multiset of rows (floats rounded).
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA"):
        return None
    try:
        if v != v:
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    ts = time.time() - t0
    if sql is None:
        return f"ROWS  {name}: {len(spdf)} rows (no oracle) {ts:.1f}s"
    t1 = time.time()
    dpdf = con.execute(sql).fetchdf()
    td = time.time() - t1
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    if sc != dc:
        return f"FAIL  {name}: columns spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"FAIL  {name}: rows spark={len(sr)} duck={len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"FAIL  {name}: {len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return f"OK    {name}: {len(sr)} rows spark {ts:.1f}s duck {td:.2f}s"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from citegraph.session import get_spark
    import __spark_entry__ as E

    spark = get_spark()
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(a.sf)
    names = a.names or list(qs)
    for n in names:
        try:
            print(compare(spark, con, n, qs[n], oracle.get(n), a.sf), flush=True)
        except Exception as e:  # report and go on
            msg = str(e).strip().splitlines()
            print(f"ERROR {n}: {type(e).__name__}: {msg[0] if msg else ''}"[:400], flush=True)


if __name__ == "__main__":
    main()
