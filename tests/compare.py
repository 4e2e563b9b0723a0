"""Run registered queries against DuckDB and compare values."""

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(columns), sorted(out, key=repr)


def kind(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(spark, con, fn, sql, folder):
    """Returns (ok, message)."""
    df = fn(spark, folder)
    got_cols, got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want_cols, want = rows(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return False, f"{got_cols}: {a} != {b}"
        if [kind(x) for x in a] != [kind(x) for x in b]:
            return False, f"{got_cols}: types of {a} != {b}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from graticule.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(folder)
    names = sys.argv[1:] or list(entry.queries())
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                ok, message = compare(spark, con, queries[name], oracle[name], folder)
            else:
                n = queries[name](spark, folder).count()
                ok, message = n > 0, f"{n} rows (no SQL)"
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            bad.append(name)
        print("ok " if ok else "BAD", name, f"{time.time() - start:.1f}s", message, flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good", "bad:", bad)
