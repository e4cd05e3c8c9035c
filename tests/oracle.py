"""Spark rows and DuckDB rows in one comparable form."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float) and x.is_integer():
            return int(x)  # pandas shows whole numbers beside a null as floats
        return str(x) if hasattr(x, "isoformat") else x

    return sorted(repr(tuple(map(plain, r))) for r in frame.values.tolist())
