"""Runs a registered query and its check on the same parquet files and compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA or v is pd.NaT:
                out.append("NULL")
            elif isinstance(v, (float, np.floating)) and not float(v).is_integer():
                out.append(repr(float(v)))
            elif isinstance(v, (bool, np.bool_)):
                out.append(str(bool(v)))
            elif isinstance(v, (int, np.integer, float, np.floating)):
                out.append(str(int(v)))
            else:
                out.append(str(list(v)) if isinstance(v, np.ndarray) else str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark_df: pd.DataFrame, check_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(check_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(check_df.columns)}"
    a, b = canonical(spark_df), canonical(check_df)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, first {sorted(spark_df.columns)} {diff[0]}"
    return None
