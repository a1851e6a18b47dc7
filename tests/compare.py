"""Compare Spark results with their SQL twins, whatever the order of rows."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def differences(df: DataFrame, connection, sql: str) -> str | None:
    """What differs, None when the columns and the multisets of rows are equal."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    wanted = Counter(
        tuple(_cell(row[names.index(name)]) for name in order) for row in cursor.fetchall()
    )
    found = Counter(tuple(_cell(row[name]) for name in order) for row in df.collect())
    if wanted == found:
        return None
    extra, missing = found - wanted, wanted - found
    return (
        f"{order}: {sum(extra.values())} rows too many, e.g. {list(extra)[:2]}; "
        f"{sum(missing.values())} missing, e.g. {list(missing)[:2]}"
    )
