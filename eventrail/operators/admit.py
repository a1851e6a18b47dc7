"""Admission: the ordered checks between a decoded request and the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.functions.fence import compute_once
from eventrail.operators.config import admission_projects
from eventrail.operators.decode import TOKEN_FIELD, decode, header, usable_token
from eventrail.operators.lookups import lookup_join

MAX_EVENT_BYTES = 256 * 1024

# Issue code -> status and response text.
RESPONSES = {
    "ingest_method_not_allowed": (405, ""),
    "ingest_project_not_found": (404, "project not found"),
    "ingest_missing_request_body": (400, "missing request body"),
    "ingest_missing_token": (401, "missing ingest token"),
    "ingest_invalid_token": (401, "invalid ingest token"),
    "ingest_conflicting_token": (401, "conflicting ingest token"),
    "ingest_query_token_not_supported": (400, "query ingest token is not supported"),
    "ingest_ip_not_allowed": (403, "ip not allowed"),
    "ingest_invalid_form": (400, "invalid form payload"),
    "ingest_payload_too_large": (413, "Payload Too Large"),
    "ingest_invalid_json": (400, "invalid json payload"),
    "ingest_wal_append_failed": (503, "WAL disk space is insufficient or unavailable"),
}


def _issue(max_event_bytes: int) -> Column:
    """First failing check; decoding issues come before all others."""
    header_token = usable_token(header(TOKEN_FIELD))
    token = F.coalesce(header_token, "body_token")
    restricted = F.size("allowed_ips") > 0
    listed = F.array_contains("allowed_ips", F.coalesce("remote_addr", F.lit("")))
    by_token = F.col("auth_mode") == "token"
    return (
        F.when(F.col("decode_issue").isNotNull(), F.col("decode_issue"))
        .when(F.col("project_id").isNull(), "ingest_project_not_found")
        .when(restricted & ~listed, "ingest_ip_not_allowed")
        .when(by_token & (header_token != F.col("body_token")), "ingest_conflicting_token")
        .when(by_token & token.isNull(), "ingest_missing_token")
        .when(by_token & (token != F.col("ingest_token")), "ingest_invalid_token")
        .when(F.octet_length("event_text") > max_event_bytes, "ingest_payload_too_large")
    )


def event_name(decoder: Column, event: Column, text: Column) -> Column:
    """``xwhat`` when it is a string, else ``default``."""
    named = F.try_variant_get(event, '$["xwhat"]', "string")
    is_text = jsonx.kind(jsonx.get(event, '$["xwhat"]')) == "STRING"
    flat = F.get_json_object(text, "$.xwhat")
    return F.coalesce(
        F.when(decoder == "json", F.when(is_text, named)).otherwise(flat), F.lit("default")
    )


def admit(
    requests: DataFrame, projects: DataFrame, max_event_bytes: int = MAX_EVENT_BYTES
) -> DataFrame:
    """Every request with its ``issue_code`` (NULL when admitted) and decoded event.

    One pass over the requests; the projects are joined by key.
    """
    decoded = decode(requests).withColumn("project_key", jsonx.strip(F.col("project_key")))
    joined = lookup_join(
        decoded,
        admission_projects(projects),
        ["project_key"],
        "left",
        spread=[F.col("request_seq"), F.col("received_at_ms")],
    )
    checked = joined.withColumn("issue_code", _issue(max_event_bytes))
    named = checked.withColumns(
        {
            "event_name": event_name(F.col("decoder"), F.col("event"), F.col("event_text")),
            "headers": F.map_filter("headers", lambda k, _: F.lower(k) != TOKEN_FIELD),
        }
    ).drop("auth_mode", "allowed_ips", "ingest_token", "body_token", "decode_issue", "event")
    return compute_once(named, "issue_code", "event_name", "event_text")


def admitted(checked: DataFrame) -> DataFrame:
    """Admitted requests in the shape the record log appends."""
    return checked.filter(F.col("issue_code").isNull()).select(
        "node_id",
        "request_seq",
        F.col("project_id").cast("int").alias("project_id"),
        "received_at_ms",
        "method",
        "path",
        "query",
        "remote_addr",
        "headers",
        F.col("event_text").alias("body"),
    )


def rejections(checked: DataFrame) -> DataFrame:
    """Refused requests with their code, status and response text."""
    rejected = checked.filter(F.col("issue_code").isNotNull())
    status, message = F.lit(None).cast("int"), F.lit(None).cast("string")
    for code, (number, text) in RESPONSES.items():
        match = F.col("issue_code") == code
        status = F.when(match, F.lit(number)).otherwise(status)
        message = F.when(match, F.lit(text)).otherwise(message)
    return rejected.select(
        "node_id", "request_seq", "received_at_ms", "method", "path", "project_key",
        "issue_code", status.alias("status"), message.alias("message"),
    )


def admission_results(checked: DataFrame) -> DataFrame:
    """Admitted requests as metric observations."""
    return checked.filter(F.col("issue_code").isNull()).select(
        "project_id",
        F.col("event_name").alias("xwhat"),
        F.lit("wal_appended").alias("result"),
        "received_at_ms",
    )
