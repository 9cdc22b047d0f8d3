"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("%.9g" % (value + 0.0) if value else "0")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return "%.9g" % value if abs(value) < 10**9 else str(value)
    if isinstance(value, decimal.Decimal):
        return canonical(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    """Returns (ok, message)."""
    df = fn(spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows={len(mine)} (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = table(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(cols)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return False, f"rows {len(mine)}/{len(theirs)} only-spark {len(a)} {list(a)[:2]} only-sql {len(b)} {list(b)[:2]}"
    return True, f"rows={len(mine)}"


def main(argv):
    import __spark_entry__ as entry
    from corpuscope.session import build_session

    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:45s} {time.time() - start:6.2f}s {message[:1500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
