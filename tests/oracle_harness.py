"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Mirrors the driver's check: same column names, same row count, and the same
multiset of rows (order-insensitive; doubles compared after rounding).

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from clauseflow.plans import registry as R
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = R.QUERIES[name](spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(_norm(r[c]) for c in sorted(scols)) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    sql = R.ORACLE.get(name)
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = [tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols)) for r in rel.fetchall()]
    out["duck_rows"] = len(drows)
    out["duck_sec"] = round(time.time() - t1, 2)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"SCHEMA spark={sorted(scols)} duck={sorted(dcols)}"
        return out
    cs, cd = Counter(srows), Counter(drows)
    if cs == cd:
        out["status"] = "OK"
    else:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        out["status"] = f"DIFF spark-only={len(list((cs - cd).elements()))} duck-only={len(list((cd - cs).elements()))}"
        out["example_spark"] = [str(x)[:300] for x in only_s]
        out["example_duck"] = [str(x)[:300] for x in only_d]
    return out


if __name__ == "__main__":
    from clauseflow.session import get_spark
    from clauseflow.plans import registry as R
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(R.QUERIES)
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            res = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            res = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if res["status"] not in ("OK", "rows-only"):
            bad += 1
        print(res, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
