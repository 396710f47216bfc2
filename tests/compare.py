"""Run a registered query next to its oracle SQL and compare results.

Mirrors the correctness gate: row count, column names, and an
order-insensitive hash of the values with columns sorted by name.
"""
from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

import duckdb

STRICT = bool(os.environ.get("COMPARE_STRICT"))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v) if STRICT else f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v) if STRICT else f"{float(v):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


_SPARK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def _spark_type(t: str) -> str:
    return _SPARK.get(t, t.upper())


def _duck_family(t: str) -> str:
    t = (t or "").upper()
    if t.startswith("DECIMAL"):
        return "DECIMAL"
    return {"NUMBER": "DOUBLE", "STRING": "VARCHAR", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP"}.get(t, t)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from stockgrid.plans import catalog
    q = catalog.REGISTRY[name]
    sdf = q.build(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if q.oracle is None:
        out["status"] = "no-oracle"
        return out
    rel = con.execute(q.oracle)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    out["oracle_cols"] = sorted(d_cols)
    s_types = {f.name: _spark_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = {d[0]: str(d[1]).upper() for d in rel.description}
    type_diff = {c: (s_types.get(c), d_types.get(c)) for c in s_types
                 if c in d_types and s_types.get(c) != _duck_family(d_types.get(c))}
    if type_diff:
        out["type_diff"] = type_diff
    sh, sl = _digest(s_cols, s_rows)
    dh, dl = _digest(d_cols, d_rows)
    ok = len(s_rows) == len(d_rows) and sorted(s_cols) == sorted(d_cols) and sh == dh
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        only_s = sorted(set(sl) - set(dl))[:3]
        only_d = sorted(set(dl) - set(sl))[:3]
        out["only_spark"] = only_s
        out["only_oracle"] = only_d
    return out


def main(argv=None):
    import argparse
    import json
    import time

    from stockgrid.session import build_session
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args(argv)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(a.sf)
    from stockgrid.plans import catalog
    names = a.names or list(catalog.REGISTRY)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            r = compare(spark, con, n, a.sf)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "ERROR", "error": repr(e)[:400]}
        r["sec"] = round(time.time() - t0, 2)
        if r["status"] not in ("match", "no-oracle"):
            bad += 1
        print(json.dumps(r), flush=True)
    print(json.dumps({"failed": bad, "total": len(names)}))
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
