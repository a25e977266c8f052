"""Rows of Spark and DuckDB in one normal form."""

import math

import pandas as pd


def norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.sql(sql)
    names = r.columns
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
