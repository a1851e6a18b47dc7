"""Processors written as Python functions, for what the declared form cannot say.

The function gets the event (plain JSON values), the request and an ``emit`` callable;
its return value is ignored. Rows travel in Arrow batches.
"""

from __future__ import annotations

import json
import shutil
import tempfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.plans.processor import DELIVERY_TYPE

_REQUEST = ["record_id", "received_at_ms", "method", "path", "remote_addr", "headers"]


@dataclass(frozen=True)
class RequestContext:
    request_id: str | None
    received_at_ms: int | None
    method: str
    path: str
    ip: str | None
    headers: Mapping[str, str]

    def header(self, name: str) -> str | None:
        return self.headers.get(name.lower())


def _dump(event: object) -> str:
    return json.dumps(
        event, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False
    )


def run_one(function: Callable, body: str, request: RequestContext) -> tuple[list, str | None]:
    """Deliveries and error of one record; an error discards the deliveries."""
    emitted: list[dict] = []

    def emit(target: str, event: object) -> None:
        if not target.strip():
            return
        try:
            text = _dump(event)
        except (TypeError, ValueError):
            return
        emitted.append({"target": target, "event_json": text})

    try:
        function(json.loads(body), request, emit)
    except Exception as error:  # noqa: BLE001 - any failure quarantines the record
        return [], str(error) or type(error).__name__
    return emitted, None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_eventrail_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="eventrail-ship-")
    archive = shutil.make_archive(f"{folder}/eventrail", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._eventrail_shipped = True


def call_functions(df: DataFrame, functions: Mapping[str, Callable]) -> DataFrame:
    """Add ``__called`` (deliveries, processor_error) for the records whose script is a function.

    All records go by in one pass; those of other scripts reach Python as nulls only.
    """
    ship_package(df.sparkSession)
    functions = dict(functions)

    @F.pandas_udf(f"deliveries {DELIVERY_TYPE}, processor_error string")
    def call(
        scripts: pd.Series, bodies: pd.Series, ids: pd.Series, received: pd.Series,
        methods: pd.Series, paths: pd.Series, ips: pd.Series, headers: pd.Series,
    ) -> pd.DataFrame:
        results = []
        for script, body, *values, names in zip(
            scripts, bodies, ids, received, methods, paths, ips, headers, strict=True
        ):
            if script is None:
                results.append(([], None))
                continue
            record_id, at, method, path, ip = values
            known = {k.lower(): v for k, v in dict(names if names is not None else {}).items()}
            request = RequestContext(record_id, int(at), method, path, ip, known)
            results.append(run_one(functions[script], body, request))
        return pd.DataFrame(results, columns=["deliveries", "processor_error"])

    mine = F.coalesce(F.col("script_key").isin(list(functions)), F.lit(False))
    wanted = [F.when(mine, F.col(name)) for name in ("script_key", "body", *_REQUEST)]
    return df.withColumn("__called", call(*wanted))
