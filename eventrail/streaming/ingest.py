"""Continuous admission of requests into the record log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventrail.functions.names import trigger_interval
from eventrail.operators import admit
from eventrail.operators.log import append_log
from eventrail.operators.metrics import rates
from eventrail.sinks.writers import batch_label, write_table


def ingest_batch(
    requests: DataFrame,
    projects: DataFrame,
    log_path: str,
    rejections_root: str | None,
    batch_id: int,
    max_event_bytes: int = admit.MAX_EVENT_BYTES,
) -> None:
    """Admit one set of requests: append to the log, keep the refused ones as a table."""
    checked = admit.admit(requests, projects, max_event_bytes).persist(StorageLevel.DISK_ONLY)
    try:
        append_log(admit.admitted(checked), log_path, batch_id)
        if rejections_root is not None:
            write_table(admit.rejections(checked), rejections_root, batch_label(batch_id))
    finally:
        checked.unpersist()


def ingest_stream(
    requests: DataFrame,
    load_projects: Callable[[], DataFrame],
    log_path: str,
    checkpoint: str,
    rejections_root: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Start admission; projects are read anew for every micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, load_projects(), log_path, rejections_root, batch_id)

    trigger = {"processingTime": trigger_interval(interval)} if interval else {"availableNow": True}
    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(run)
        .trigger(**trigger)
        .start()
    )


def rate_stream(
    observations: DataFrame, path: str, checkpoint: str, width: str = "1 minute",
    late: str = "10 minutes",
) -> StreamingQuery:
    """Windowed event rates of a stream, appended once a window is closed."""
    return (
        rates(observations, width, late)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
