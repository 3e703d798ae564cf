"""Compare catalogue queries with their DuckDB oracle: ``python tests/oracle.py [sf] [names]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else (0.0 if f == 0 else f)
    if isinstance(v, datetime):
        return v.isoformat(" ")
    if isinstance(v, date):
        return v.isoformat()
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def compare(spark_df, con, sql):
    """(ok, message, row count)"""
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want = normal([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return False, f"{len(got[1])} rows != {len(want[1])}; spark {got[1][:2]} oracle {want[1][:2]}", len(got[1])
    for a, b in zip(got[1], want[1]):
        if a != b:
            return False, f"{got[0]}\n   spark  {a}\n   oracle {b}", len(got[1])
    return True, "", len(got[1])


def main(argv):
    from holdscope.catalogue import ORACLES, QUERIES
    from holdscope.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                ok, message, n = compare(df, con, ORACLES[name])
            else:
                ok, message, n = True, "(no oracle)", len(df.collect())
        except Exception as e:  # report every query, not only the first failure
            ok, message, n = False, f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
