"""Small literal frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from eventrail.functions import jsonx
from eventrail.functions.checks import Step
from eventrail.functions.extract import with_error
from eventrail.operators.log import LOG_COLUMNS, LOG_SCHEMA


def events(spark: SparkSession, *bodies) -> DataFrame:
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return jsonx.parse_strict(spark.createDataFrame(rows, "i int, body string"), "body")


def errors(spark: SparkSession, body, *checks: Step) -> list[str | None]:
    """Error of each check on one event, in one job."""
    df = events(spark, body)
    for i, check in enumerate(checks):
        df = with_error(df, [check], out=f"e{i}")
    row = df.select(*[f"e{i}" for i in range(len(checks))]).first()
    return list(row)


def records(spark: SparkSession, *bodies, project: int = 1, node: str = "n", **changes) -> DataFrame:
    rows = []
    for lsn, body in enumerate(bodies, start=1):
        row = {
            "record_id": f"wal-{lsn}-{lsn}", "lsn": lsn, "project_id": project,
            "received_at_ms": 1000 + lsn, "method": "POST", "path": "/ingest/p", "query": None,
            "remote_addr": "127.0.0.1", "headers": {"User-Agent": "ua"},
            "body": body if isinstance(body, str) else json.dumps(body, separators=(",", ":")),
            "node_id": node,
        }
        row.update(changes)
        rows.append(tuple(row[name] for name in LOG_COLUMNS))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def scripts(spark: SparkSession, *pairs) -> DataFrame:
    return spark.createDataFrame(list(pairs), "project_id int, script_key string")
