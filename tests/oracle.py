"""Run queries against their SQL counterparts: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    start = time.time()
    got_cols, got = rows_of(df.columns, df.collect())
    print(f"   collected in {time.time() - start:.1f}s", end=" ")
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2]
        return f"{len(got)} rows, expected {len(want)}; only ours {extra}, only theirs {sorted(set(want) - set(got))[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return None if not diff else f"{len(diff)} of {len(got)} rows differ, first {str(diff[0])[:700]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from mailsift.session import get_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf)
            else:
                df = queries[name](spark, sf)
                problem, n = None, df.count()
                print(f"   {name}: {n} rows, no SQL, {df.columns}")
        except Exception as exc:  # report and go on with the others
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
