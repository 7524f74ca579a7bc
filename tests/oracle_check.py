"""Compare each registered Spark query with its DuckDB oracle SQL.

Usage:  python tests/oracle_check.py [sf_dir] [query ...]

Rows are compared as bags after sorting columns by name; floats are
compared after rounding to 6 decimals.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from keelson.sources.tables import TABLES, table_path  # noqa: E402


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _key(row):
    return tuple((x is None, repr(type(x)), x if not isinstance(x, tuple) else repr(x)) for x in row)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=_key)
    return cols, out


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    con = con or duck_conn(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    res["duck_rows"] = len(drows)
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    if sc != dc:
        res["status"] = f"column mismatch spark={sc} duck={dc}"
    elif sr != dr:
        diff = [r for r in sr if r not in set(dr)][:3]
        diff2 = [r for r in dr if r not in set(sr)][:3]
        res["status"] = f"value mismatch; spark-only {diff}; duck-only {diff2}"
    else:
        res["status"] = "match"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from keelson.plans.catalog import ORACLE, QUERIES
    from keelson.session import build_session
    spark = build_session()
    con = duck_conn(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, sf_dir, name, fn, ORACLE.get(name), con)
        except Exception as e:  # noqa: BLE001
            r = {"query": name, "status": f"error {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "no-oracle")
        print(r, flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
