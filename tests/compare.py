"""Compares a DataFrame with DuckDB's answer, rows in any order."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else int(v) if math.isfinite(v) and v == int(v) else v
    return v


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in pdf[columns].astype(object).values.tolist())


def duck(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if glob.glob(f"{path}/*.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def same(df, sql, folder):
    a, b = rows(df.toPandas()), rows(duck(sql, folder))
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1], [x for x in zip(a[1], b[1]) if x[0] != x[1]][:3]
