"""Rows of a Spark frame and of a DuckDB query in one comparable form."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v) -> str:
    v = v.item() if hasattr(v, "item") else v
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def comparable(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    cols = sorted(frame.columns)
    return cols, sorted(tuple(_cell(v) for v in row) for row in frame[cols].itertuples(index=False, name=None))
