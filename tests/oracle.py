"""Compares a query with its SQL in DuckDB on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connect(d=DATA):
    db = duckdb.connect()
    for f in Path(d).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6)
    if isinstance(x, np.integer):
        return int(x)
    return bool(x) if isinstance(x, np.bool_) else x


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def check(spark, query, sql, db, d=DATA):
    a, b = query(spark, d).toPandas(), db.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
