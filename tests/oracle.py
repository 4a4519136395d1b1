"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb
import pandas as pd


def connect(d: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, int | float) and not isinstance(x, bool):
            return f"{float(x):.6g}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
