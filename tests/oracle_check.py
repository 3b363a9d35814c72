"""Run each ``queries()`` entry against its ``oracle_sql()`` twin.

Columns are sorted by name, rows compared as an order-insensitive
multiset; floats are compared at 12 significant digits. Used by the test
suite and runnable by hand:

    python tests/oracle_check.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.12g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_cols, d_rows = canon(d_cols, res.fetchall())
    ok = s_cols == d_cols and s_rows == d_rows
    detail = ""
    if s_cols != d_cols:
        detail = f"columns spark={s_cols} duck={d_cols}"
    elif s_rows != d_rows:
        only_s = list((s_rows - d_rows).elements())[:3]
        only_d = list((d_rows - s_rows).elements())[:3]
        detail = (f"rows spark={sum(s_rows.values())} duck={sum(d_rows.values())} "
                  f"only_spark={only_s} only_duck={only_d}")
    return ok, sum(s_rows.values()), t1 - t0, detail


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(argv[2:])
    import __spark_entry__ as E
    from civicspark.session import build_session
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if wanted and key not in wanted:
            continue
        if key not in sql:
            df = fn(spark, sf_dir)
            print(f"{key:32s} rows-only {df.count()}")
            continue
        try:
            ok, n, secs, detail = compare(spark, con, key, fn, sql[key], sf_dir)
        except Exception as e:  # report and go on
            ok, n, secs, detail = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{key:32s} {'OK ' if ok else 'BAD'} rows={n:<7d} {secs:6.2f}s {detail}", flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
