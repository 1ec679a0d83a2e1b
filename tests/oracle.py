"""Order-insensitive comparison of a query with its SQL on DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def run_sql(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for f in os.listdir(folder):
        where = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{where}'")
    return c.execute(sql).fetch_df()


def _value(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_value, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer, float, np.floating)):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(_value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
