"""Counters, histograms, lag and node health as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds in seconds of the default histogram buckets.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BUCKET_LABELS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0")
LABELS = ("project_id", "xwhat", "result")
REFRESH_SECONDS = 3


def events_total(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*LABELS).agg(F.count(F.lit(1)).alias("events_total"))


def bucket_sums(seconds: str = "seconds") -> list[Column]:
    """Aggregates of a histogram: one count per bucket, the count and the sum."""
    value = F.col(seconds)
    counts = [F.count_if(value <= bound).alias(f"__le{i}") for i, bound in enumerate(BUCKETS)]
    return [*counts, F.count(value).alias("duration_count"), F.sum(value).alias("duration_sum")]


def bucket_rows(totals: DataFrame, *others: str) -> DataFrame:
    """One row per label set and bucket of such aggregates."""
    rows = [
        F.struct(F.lit(label).alias("le"), F.col(f"__le{i}").alias("bucket_count"))
        for i, label in enumerate(BUCKET_LABELS)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("duration_count").alias("bucket_count")))
    return totals.select(
        *LABELS, *others, F.inline(F.array(*rows)).alias("le", "bucket_count"),
        "duration_count", "duration_sum",
    )


def duration_histogram(observations: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Cumulative buckets, sum and count per label set, one row per bucket."""
    return bucket_rows(observations.groupBy(*LABELS).agg(*bucket_sums(seconds)))


def log_gauges(bounds: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Highest LSN, checkpoint and lag per node; the lag never goes below zero."""
    checkpoint = F.coalesce("checkpoint_lsn", F.lit(0))
    return bounds.join(checkpoints, "node_id", "left").select(
        "node_id",
        F.col("tail_lsn").alias("max_lsn"),
        checkpoint.alias("checkpoint_lsn"),
        F.greatest(F.lit(0), F.col("tail_lsn") - checkpoint).alias("replay_lag_lsn"),
    )


def error_totals(rejections: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Totals of refused requests and quarantined records by code."""
    refused = rejections.groupBy(F.col("issue_code").alias("code")).agg(
        F.count(F.lit(1)).alias("total")
    )
    held = quarantined.groupBy("code").agg(F.count(F.lit(1)).alias("total"))
    return refused.select(F.lit("ingest").alias("stage"), "code", "total").unionByName(
        held.select(F.lit("replay").alias("stage"), "code", "total")
    )


def quarantine_totals(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("code", "action", "xwhat", "target").agg(
        F.count(F.lit(1)).alias("total")
    )


def delivery_totals(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("sink_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.octet_length("event_json")).alias("bytes"),
    )


def node_status(
    heartbeats: DataFrame, now_ms: int, refresh_seconds: int = REFRESH_SECONDS
) -> DataFrame:
    """Latest heartbeat per node; a running node not seen for three refreshes is stale."""
    latest = heartbeats.groupBy("node_id").agg(
        F.max_by(F.struct("status", "version", "last_seen_at"), F.col("last_seen_at")).alias("last")
    )
    silent = F.lit(now_ms) - F.col("last.last_seen_at") > 3 * refresh_seconds * 1000
    status = F.when((F.col("last.status") == "running") & silent, "stale").otherwise(
        F.col("last.status")
    )
    return latest.select("node_id", status.alias("status"), "last.version", "last.last_seen_at")


def rates(observations: DataFrame, width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Events per time window and label set; ``late`` bounds the state of a stream."""
    timed = observations.withColumn("received_at", F.timestamp_millis("received_at_ms"))
    if late:
        timed = timed.withWatermark("received_at", late)
    return timed.groupBy(F.window("received_at", width), *LABELS).agg(
        F.count(F.lit(1)).alias("events")
    ).select(
        F.unix_millis("window.start").alias("window_start_ms"), *LABELS, "events"
    )
