"""Compare a Spark result with its DuckDB oracle as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def kind(value) -> str:
    return type(plain(value)).__name__


def row_multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


def difference(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description."""
    ours = spark_df.collect()
    cursor = con.execute(sql)
    theirs_columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(theirs_columns)}"
    a, b = row_multiset(spark_df.columns, ours), row_multiset(theirs_columns, theirs)
    if a != b:
        return f"{len(ours)} vs {len(theirs)} rows; only ours {list((a - b))[:2]}; only theirs {list((b - a))[:2]}"
    return None
