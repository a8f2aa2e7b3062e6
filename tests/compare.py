"""Rows of a Spark query against those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb


def rows(frame, columns):
    return Counter(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def assert_same(df, sql, folder):
    got, want = df.toPandas(), connect(folder).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
