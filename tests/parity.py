"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") or x.__class__.__name__ == "Decimal" else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))
