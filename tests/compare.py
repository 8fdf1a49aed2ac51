"""Compare registered queries with their SQL: ``python tests/compare.py [sf_dir] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from factloom.plans.views import TABLES


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    rows = [tuple(_plain(r[k]) for k in order) for r in cur.fetchall()]
    con.close()
    return [names[k] for k in order], sorted(rows, key=repr)


def compare(spark, queries, oracles, name, sf_dir):
    t0 = time.time()
    names, got = rows_of_spark(queries[name](spark, sf_dir))
    t1 = time.time()
    if name not in oracles:
        return f"rows only ({len(got)})", t1 - t0, 0.0
    want_names, want = rows_of_duckdb(oracles[name], sf_dir)
    t2 = time.time()
    if names != want_names:
        return f"COLUMNS {names} {want_names}", t1 - t0, t2 - t1
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"DIFFERS spark {len(got)} sql {len(want)}\n  only spark {sorted(a - b)[:3]}\n  only sql   {sorted(b - a)[:3]}", t1 - t0, t2 - t1
    return f"ok ({len(got)})", t1 - t0, t2 - t1


def main():
    from conftest import make_spark

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = make_spark()
    bad = 0
    for name in args or queries:
        try:
            said, a, b = compare(spark, queries, oracles, name, sf_dir)
        except Exception as e:
            said, a, b = "ERROR " + str(e)[:1200], 0, 0
        bad += not said.startswith(("ok", "rows"))
        print(f"{name:28s} {a:6.2f} {b:6.2f}  {said}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
