"""Compare every registered query with its SQL twin on DuckDB."""

from __future__ import annotations

import decimal
import glob
import os
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    """Empty string when equal, else a short report; also returns row count and seconds."""
    t = time.time()
    df = fn(spark, sf)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "", len(got), took
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}", len(got), took
    types = {n: type(next((v[i] for v in got if v[i] is not None), None)).__name__ for i, n in enumerate(got_names)}
    wtypes = {n: type(next((v[i] for v in want if v[i] is not None), None)).__name__ for i, n in enumerate(want_names)}
    if types != wtypes:
        return f"types { {n: (types[n], wtypes[n]) for n in types if types[n] != wtypes[n]} }", len(got), took
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; spark {x} sql {y}", len(got), took
    return "", len(got), took
