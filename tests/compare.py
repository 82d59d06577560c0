"""Results of a query and of its SQL as comparable rows."""

import math
import os

import duckdb
import pandas as pd


def views(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if hasattr(x, "as_tuple") or isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "uint")):
        return repr(round(float(x), 6))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_value, r)) for r in df.itertuples(index=False))
