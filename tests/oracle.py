"""Comparing a query with its DuckDB counterpart: same columns, same rows in any order."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist())


def check(query, sql, spark, sf_dir):
    (a, x), (b, y) = rows(query(spark, sf_dir).toPandas()), rows(database(sf_dir).sql(sql).df())
    assert a == b
    assert x == y, (list((x - y))[:3], list((y - x))[:3])
