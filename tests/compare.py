"""Compare a Spark result with the result of its SQL in DuckDB: column names, row count, values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and math.isfinite(value):
        return float(f"{value:.12g}")
    return value


def difference(result: DataFrame, connection, sql: str) -> str | None:
    """None if both agree, else what differs."""
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} but SQL has {sorted(names)}"
    order = sorted(names)
    wanted = Counter(
        tuple(_plain(row[names.index(n)]) for n in order) for row in cursor.fetchall()
    )
    found = Counter(tuple(_plain(row[n]) for n in order) for row in result.collect())
    if wanted == found:
        return None
    extra, lacking = list((found - wanted).items())[:3], list((wanted - found).items())[:3]
    return (
        f"{sum(found.values())} rows but SQL has {sum(wanted.values())}; "
        f"only Spark {str(extra)[:600]}; only SQL {str(lacking)[:600]}"
    )
