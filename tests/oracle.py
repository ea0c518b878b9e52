"""Run a registered query next to its SQL twin and compare the rows.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value else "0.0"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    started = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    spent = time.time() - started
    if sql is None:
        return True, f"{name}: rows={len(rows)} (no SQL) {spent:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    sql_spent = time.time() - started
    mine, theirs = _bag(df.columns, rows), _bag(names, expected)
    ok = sorted(df.columns) == sorted(names) and mine == theirs
    note = f"{name}: spark={len(rows)} sql={len(expected)} {spent:.1f}s/{sql_spent:.1f}s"
    if not ok:
        note += f"\n   cols {sorted(df.columns)}\n   cols {sorted(names)}"
        note += f"\n   only spark {list((mine - theirs).items())[:3]}\n   only sql   {list((theirs - mine).items())[:3]}"
    return ok, note


def main(argv):
    import __spark_entry__ as entry
    from rosterforge.session import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("oracle", f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{name}: {type(error).__name__} {str(error)[:700]}"
        print("ok  " if ok else "BAD ", note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
