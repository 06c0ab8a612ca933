"""Side-by-side check of registered queries and their SQL, exact to the value."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted((TABLES / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if str(frame[column].dtype).startswith("datetime64"):
            frame[column] = frame[column].astype("datetime64[us]")
        elif str(frame[column].dtype) == "Int64":  # whole numbers with nulls
            frame[column] = frame[column].astype("float64")
        elif frame[column].dtype == object:
            frame[column] = frame[column].map(str)
        elif frame[column].dtype.kind == "f":
            frame[column] = frame[column] + 0.0
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if a[c].dtype != b[c].dtype]
    if kinds:
        return f"types {kinds}"
    for column in a.columns:
        unequal = ~((a[column] == b[column]) | (a[column].isna() & b[column].isna()))
        if unequal.any():
            at = unequal.idxmax()
            return f"{column}: {int(unequal.sum())} values, first {a.loc[at].to_dict()} != {b.loc[at].to_dict()}"
    return None
