"""Run named queries on Spark and their SQL twins on DuckDB, compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from edgewise import oracle, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_sec": round(t1 - t0, 2), "rows": len(srows)}
    sql = oracle.SQL.get(name)
    if sql is None:
        out["status"] = "no-oracle"
        return out
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    out["duck_sec"] = round(time.time() - t1, 2)
    if sorted(dcols) != cols:
        out["status"] = f"COLUMNS spark={cols} duck={sorted(dcols)}"
        return out
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    out["duck_rows"] = len(drows)
    a, b = sorted(srows, key=_key), sorted(drows, key=_key)
    if a == b:
        out["status"] = "ok"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["status"] = "MISMATCH"
        out["sample"] = diff
    return out


def main(argv):
    from edgewise import queries
    from edgewise.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries.QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": f"ERROR {type(ex).__name__}: {str(ex)[:300]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
