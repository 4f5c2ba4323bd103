"""A query's Spark result against its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') or [path]!r})")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def compare(df, sql: str, con) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want = rows(found.columns, found.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for g, w in zip(got[1], want[1]):
        assert g == w, (g, w)
