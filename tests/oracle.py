"""Runs registered queries and their SQL side by side."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("WINDLASS_DATA", "/root/testdata")


def sql_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if path := glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{path[0]}')")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([str(x) for x in v])
        if v is None or v is pd.NA or v != v:
            return "-"
        return f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
