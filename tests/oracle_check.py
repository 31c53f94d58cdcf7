"""Run every registered query on Spark and its oracle SQL on DuckDB, compare results.

    python tests/oracle_check.py [sf_dir] [name-substring ...]

Prints one line per query: OK / MISMATCH / ERROR with row counts and the first difference.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.fixtures import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        return ("f", float(f"{v:.9g}"))
    if isinstance(v, bool):
        return ("i", int(v))
    if isinstance(v, int):
        return ("f", float(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("t", dt.datetime(v.year, v.month, v.day).isoformat())
    if isinstance(v, (list, tuple)):  # nested floats are compared to the last digit
        return ("l",) + tuple(("f", x) if isinstance(x, float) and not math.isnan(x) else _norm(x) for x in v)
    if isinstance(v, dict):
        return ("d",) + tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return ("s", str(v))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    rows = sdf.collect()
    cols = sdf.columns
    t1 = time.time()
    if sql is None:
        return "ROWS", f"{len(rows)} rows (no oracle) {t1 - t0:.1f}s"
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    if sorted(cols) != sorted(dcols):
        return "MISMATCH", f"columns spark={cols} duck={dcols}"
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    if len(a) != len(b):
        return "MISMATCH", f"rows spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return "MISMATCH", f"first diff cols={order}\n   spark={x}\n   duck ={y}"
    tinfo = ", ".join(f"{c}:{types[c]}/{dtypes[c]}" for c in order)
    return "OK", f"{len(a)} rows {t1 - t0:.1f}s [{tinfo}]"


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    from tessera.session import get_spark
    import __spark_entry__ as E

    spark = get_spark()
    con = duck(sf_dir)
    qs = E.queries()
    orc = E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and not any(a in name for a in args):
            continue
        try:
            status, msg = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, msg = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if status in ("MISMATCH", "ERROR"):
            bad += 1
        print(f"{status:8s} {name}: {msg}", flush=True)
    print(f"done: {bad} bad")


if __name__ == "__main__":
    main()
