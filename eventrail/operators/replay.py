"""Replay: parse, check the project, run the processor, plan deliveries or quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.functions.fence import compute_once
from eventrail.operators.lookups import lookup_join
from eventrail.operators.python_processor import call_functions
from eventrail.plans.processor import Processor, process

QUARANTINE_SCHEMA = "eventrail.quarantine.v1"
QUARANTINE_ACTION = "quarantine_record"

# Codes of records that cannot be delivered, and of what stops or blocks replay.
QUARANTINE_CODES = (
    "replay_invalid_json_body",
    "replay_unknown_project",
    "replay_processor_runtime_failed",
    "replay_unknown_sink_target",
    "replay_empty_sink_target",
)
LSN_GAP_CODE = "replay_wal_lsn_gap"
SINK_FAILED_CODE = "replay_sink_send_failed"


def _bad_target(sinks: Iterable[str]) -> Column:
    """First planned target that is blank or not a configured sink; NULL when all are fine."""
    entries = F.col("deliveries")["target"]
    fine = F.array(*[F.lit(sink) for sink in sorted(set(sinks))], F.lit(None).cast("string"))
    return F.get(F.array_except(entries, fine), F.lit(0))


def plan(
    log: DataFrame,
    project_scripts: DataFrame,
    processors: Mapping[str, Processor | Callable],
    sinks: Iterable[str],
) -> DataFrame:
    """Every record with ``code``, ``message``, ``bad_target``, ``xwhat`` and ``deliveries``.

    ``code`` is NULL for a record in good standing; ``xwhat`` is read for the others only.
    ``project_scripts`` holds ``project_id, script_key`` of the enabled projects.
    A record with one undeliverable target is quarantined as a whole.
    """
    known = lookup_join(
        log,
        project_scripts.select("project_id", "script_key", F.lit(True).alias("__known")),
        ["project_id"],
        "left",
        spread=[F.col("node_id"), F.col("lsn")],
    )
    parsed = _described(jsonx.parse_strict(known, "body"))
    declared = {k: p for k, p in processors.items() if isinstance(p, Processor)}
    functions = {k: p for k, p in processors.items() if not isinstance(p, Processor)}
    if functions:
        parsed = call_functions(parsed, functions)
    done = process(parsed, declared) if declared else _unprocessed(parsed)
    if functions:
        by_python = F.coalesce(F.col("script_key").isin(list(functions)), F.lit(False))
        done = done.withColumns(
            {
                name: F.when(by_python, F.col(f"__called.{name}")).otherwise(F.col(name))
                for name in ("deliveries", "processor_error")
            }
        ).drop("__called")
    return _verdict(done.drop("event"), sinks, list(processors))


def _described(parsed: DataFrame) -> DataFrame:
    """Add what the verdict needs of the event, so that the event itself need not be passed on."""
    name = jsonx.get(F.col("event"), '$["xwhat"]')
    text = F.try_variant_get(name, "$", "string")
    return parsed.withColumns(
        {
            "__valid": F.col("event").isNotNull(),
            "xwhat": F.when(jsonx.kind(name) == "STRING", text),
        }
    )


def _unprocessed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "deliveries": F.array().cast("array<struct<target:string,event_json:string>>"),
            "processor_error": F.lit(None).cast("string"),
        }
    )


def _verdict(processed: DataFrame, sinks: Iterable[str], scripts: list[str]) -> DataFrame:
    processed = processed.withColumn("bad_target", _bad_target(sinks))
    unknown_script = F.concat(F.lit("no processor `"), F.col("script_key"), F.lit("`"))
    failure = F.coalesce(
        "processor_error", F.when(~F.col("script_key").isin(scripts), unknown_script)
    )
    blank = jsonx.strip(F.col("bad_target")) == ""
    code = (
        F.when(~F.col("__valid"), "replay_invalid_json_body")
        .when(F.col("__known").isNull(), "replay_unknown_project")
        .when(failure.isNotNull(), "replay_processor_runtime_failed")
        .when(blank, "replay_empty_sink_target")
        .when(F.col("bad_target").isNotNull(), "replay_unknown_sink_target")
    )
    # The messages of records that are held.
    message = (
        F.when(~F.col("__valid"), "invalid wal record json body")
        .when(
            F.col("__known").isNull(),
            F.concat(F.lit("wal record references unknown project `"), "project_id", F.lit("`")),
        )
        .when(failure.isNotNull(), failure)
        .when(blank, "processor emitted empty sink target")
        .when(
            F.col("bad_target").isNotNull(),
            F.concat(F.lit("processor emitted unknown sink target `"), "bad_target", F.lit("`")),
        )
    )
    judged = (
        processed.withColumns({"code": code, "message": message})
        .withColumn("xwhat", F.when(F.col("code").isNotNull(), F.col("xwhat")))
        .drop("__known", "__valid", "processor_error")
    )
    return compute_once(judged, "code", "message", "bad_target", "xwhat", "deliveries")


def deliveries(planned: DataFrame) -> DataFrame:
    """One row per delivery of the records in good standing, in emit order (``seq``)."""
    good = planned.filter(F.col("code").isNull())
    exploded = good.select(
        "node_id", "lsn", "project_id", "received_at_ms",
        F.posexplode("deliveries").alias("seq", "delivery"),
    ).filter(F.col("delivery").isNotNull())
    return exploded.select(
        "node_id", "lsn", "seq", "project_id", "received_at_ms",
        F.col("delivery.target").alias("sink_id"), "delivery.event_json",
    )


def quarantine(planned: DataFrame) -> DataFrame:
    """Undeliverable records with their reason and the raw body."""
    unknown_or_empty = F.col("code") == "replay_unknown_sink_target"
    return planned.filter(F.col("code").isNotNull()).select(
        F.lit(QUARANTINE_SCHEMA).alias("schema"),
        "code",
        F.lit(QUARANTINE_ACTION).alias("action"),
        "record_id",
        "node_id",
        "lsn",
        "received_at_ms",
        "method",
        "path",
        "query",
        "xwhat",
        F.when(unknown_or_empty, F.col("bad_target")).alias("target"),
        "message",
        F.concat_ws(": ", "code", "message").alias("error"),
        jsonx.base64_line(F.col("body").cast("binary")).alias("body_base64"),
    )
