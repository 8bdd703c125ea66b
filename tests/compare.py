"""Compares registered queries with their SQL twins, column by column."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None:
        return "\0"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    assert cols == want_cols, f"columns {cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        extra = sorted(a - b)[:2]
        missing = sorted(b - a)[:2]
        raise AssertionError(
            f"{len(got)} rows vs {len(want)}; {len(a - b)} only here {extra}; {len(b - a)} only in SQL {missing}"
        )
    return len(got)


if __name__ == "__main__":
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = make_session()
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                n = len(fn(spark, sf_dir).collect())
                print(f"rows {name} {n} {time.time() - start:.2f}s", flush=True)
            else:
                n = compare(spark, con, sf_dir, fn, sql)
                print(f"ok   {name} {n} {time.time() - start:.2f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
    print("failures", bad)
