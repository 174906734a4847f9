"""Compare a query with its SQL, as the rows of sorted columns."""

import glob
import os

import duckdb
import numpy as np


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb" or str(df[c].dtype) in ("Int64", "Int32", "Float64", "boolean"):
            df[c] = df[c].astype("float64").round(6)
        else:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    out = df.astype(object).where(df.notna(), None).values.tolist()
    return sorted(map(tuple, out), key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, sf_dir, f, sql):
    a, b = f(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
