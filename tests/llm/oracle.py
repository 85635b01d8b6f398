"""Compare a query with its SQL on one folder of tables."""

import glob
import os

import duckdb


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def sql_rows(sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    cols = sorted(names)
    return cols, sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())
