"""Spark-vs-DuckDB comparison in the driver's manner: row count, column
names, and an order-insensitive hash of values (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return v


def digest(names: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = sorted(repr([norm(r[i]) for i in order]) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), [names[i] for i in order], h


def compare(spark_df, sql: str, sf_dir: str):
    names = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    con = duck(sf_dir)
    cur = con.execute(sql)
    dnames = [d[0] for d in cur.description]
    drows = cur.fetchall()
    s = digest(names, srows)
    d = digest(dnames, drows)
    return s, d, srows, drows, names, dnames
