"""Side-by-side comparison of a query with its SQL on DuckDB."""

import glob
import os

import duckdb
import numpy as np


def frame(sql: str, sf: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return c.sql(sql).df()


def rows(pdf):
    def plain(v):
        if isinstance(v, list | np.ndarray):
            return tuple(map(plain, v))
        if isinstance(v, float | np.floating):
            return "nan" if v != v else f"{v:.9g}"
        if v is None or v != v:
            return None
        return int(v) if isinstance(v, np.integer) else v

    cols = sorted(pdf.columns)
    return cols, sorted((tuple(map(plain, r)) for r in pdf[cols].astype(object).itertuples(index=False)), key=repr)
