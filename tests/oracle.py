"""Runs a registered query and its SQL twin on the same files and compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if pd.api.types.is_float_dtype(frame[column]):
            frame[column] = frame[column].map(lambda v: "" if pd.isna(v) else repr(float(v)))
        elif pd.api.types.is_integer_dtype(frame[column]) and frame[column].isna().any():
            frame[column] = frame[column].map(lambda v: "" if pd.isna(v) else repr(float(v)))
        else:
            frame[column] = frame[column].map(lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same rows; else a short account."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    # a column of whole numbers with nulls is one of floats in one frame and not in the other
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(got) and not (set(k) == {"i", "f"} and want[c].isna().any())}
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return f"types {odd}" if odd else ""
