"""Hold a query's rows against those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in frame.astype(object)[columns].values.tolist())


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con
