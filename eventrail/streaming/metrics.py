"""Metrics of streams that outlive a restart: running totals, and nodes that fall silent."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventrail.functions.names import trigger_interval
from eventrail.operators.metrics import BUCKETS, LABELS, REFRESH_SECONDS, bucket_rows, bucket_sums
from eventrail.operators.python_processor import ship_package
from eventrail.sinks.writers import batch_label, write_table

NODE = "node_id string, status string, version string, last_seen_at bigint"


def _started(frame: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    """A stream of changed rows, each micro-batch of them in its own folder, written once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_table(batch, path, batch_label(batch_id))

    trigger = {"processingTime": trigger_interval(interval)} if interval else {"availableNow": True}
    writer = frame.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
    return writer.foreachBatch(store).trigger(**trigger).start()


def _newest(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """The row of each key that was written last."""
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)
    others = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*key, "last.*")


TOTALS = (
    "project_id bigint, xwhat string, result string, events_total bigint, "
    + "".join(f"__le{n} bigint, " for n in range(len(BUCKETS)))
    + "duration_count bigint, duration_sum double"
)


def totals_stream(
    observations: DataFrame, path: str, checkpoint: str, seconds: str = "seconds", interval: str | None = None
) -> StreamingQuery:
    """Counters and latency histograms since the first start, in the stream's state store.

    A restart goes on from the checkpoint: nothing is counted twice or forgotten. The state holds one
    row per label set; every micro-batch writes the rows that it changed.
    """
    sums = observations.groupBy(*LABELS).agg(F.count(F.lit(1)).alias("events_total"), *bucket_sums(seconds))
    kept = sums.select(F.col("project_id").cast("bigint"), *sums.columns[1:])
    return _started(kept, path, checkpoint, interval)


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals by now: events of each label set, and its histogram by bucket."""
    newest = _newest(spark, path, TOTALS, list(LABELS))
    return bucket_rows(newest, "events_total")


def node_stream(
    heartbeats: DataFrame,
    path: str,
    checkpoint: str,
    refresh_seconds: int = REFRESH_SECONDS,
    interval: str | None = None,
    by_event_time: bool = False,
) -> StreamingQuery:
    """Changes of the state of nodes; a running one turns stale after three silent refreshes.

    That needs no event: a timer of each node runs out. Time is the clock of the executors, or the
    newest heartbeat of all nodes (``by_event_time``). Heartbeats that arrive after a later one of
    their node change nothing.
    """
    ship_package(heartbeats.sparkSession)
    silent = 3 * refresh_seconds * 1000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(status: str, version: str, seen: int) -> pd.DataFrame:
            return pd.DataFrame([(key[0], status, version, seen)], columns=["node_id", "status", "version", "last_seen_at"])

        if state.hasTimedOut:
            _, version, seen = state.get
            state.update(("stale", version, seen))
            yield row("stale", version, seen)
            return
        before = state.getOption
        status, version, seen = before or (None, None, -1)
        for batch in batches:
            last = batch.iloc[batch["last_seen_at"].to_numpy().argmax()]
            if last["last_seen_at"] >= seen:
                status, version, seen = last["status"], last["version"], int(last["last_seen_at"])
        now = state.getCurrentWatermarkMs() if by_event_time else int(time.time() * 1000)
        if status == "running" and now - seen > silent:
            status = "stale"
        state.update((status, version, seen))
        if status == "running":
            if by_event_time:
                state.setTimeoutTimestamp(max(seen + silent, now + 1))
            else:
                state.setTimeoutDuration(max(1, seen + silent + 1 - now))
        if before != (status, version, seen):
            yield row(status, version, seen)

    timed = heartbeats.withColumn("seen", F.timestamp_millis("last_seen_at"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout
    if by_event_time:
        timed, timeout = timed.withWatermark("seen", "0 seconds"), GroupStateTimeout.EventTimeTimeout
    changes = timed.groupBy("node_id").applyInPandasWithState(
        follow, NODE, "status string, version string, last_seen_at bigint", "update", timeout
    )
    return _started(changes, path, checkpoint, interval)


def node_states(spark: SparkSession, path: str) -> DataFrame:
    """The state of each node by now."""
    return _newest(spark, path, NODE, ["node_id"])
