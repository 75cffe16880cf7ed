"""Run registered queries beside their SQL and compare whole sorted results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def compare(spark, con, name, make, sql, folder):
    start = time.time()
    df = make(spark, folder)
    mine, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    cur = con.execute(sql)
    theirs, their_cols = rows_of([c[0] for c in cur.description], cur.fetchall())
    problem = None
    if cols != their_cols:
        problem = f"columns {cols} / {their_cols}"
    elif len(mine) != len(theirs):
        problem = f"rows {len(mine)} / {len(theirs)}"
    elif mine != theirs:
        diff = next((a, b) for a, b in zip(mine, theirs) if a != b)
        problem = f"values {sum(a != b for a, b in zip(mine, theirs))} of {len(mine)}, first {str(diff)[:600]}"
    return problem, len(mine), took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tapeloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name in names:
        try:
            if name not in oracle:
                print(f"NOSQL {name}", flush=True)
                continue
            problem, n, took = compare(spark, con, name, entry.queries()[name], oracle[name], folder)
        except Exception as failure:  # noqa: BLE001
            problem, n, took = f"{type(failure).__name__}: {str(failure)[:700]}", 0, 0
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} rows={n} {took:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
