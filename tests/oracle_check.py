"""Run registered queries next to their SQL: ``python tests/oracle_check.py [folder] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(name, spark_df, con, sql):
    cols = spark_df.columns
    got = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    ocols = [x[0] for x in cur.description]
    want = rows_of(ocols, cur.fetchall())
    if sorted(cols) != sorted(ocols):
        return f"columns {sorted(cols)} != {sorted(ocols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} | {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} | {bad[0][1]}"
    if not got:
        return "no rows"
    return f"ok {len(got)}"


def main():
    import __spark_entry__ as e
    from pricelattice.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name, fn in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            sql = e.oracle_sql().get(name)
            res = compare(name, df, con, sql) if sql else f"ok {len(df.collect())} (rows only)"
        except Exception as exc:  # report and go on to the next query
            res = f"error {type(exc).__name__}: {str(exc)[:600]}"
        failed += not res.startswith("ok")
        print(f"{time.time() - t0:6.1f}s  {name:40s} {res}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
