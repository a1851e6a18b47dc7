"""Totals and node states that outlive a restart."""

import time

from pyspark.sql import functions as F

from eventrail.session import scratch_path
from eventrail.streaming.metrics import NODE, node_states, node_stream, running_totals, totals_stream


class Feed:
    """A folder that rows are added to, and a stream over it."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.root = spark, schema, scratch_path(spark, "feed")

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def start(self, stream, **options):
        rows = self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")
        return stream(rows, f"{self.root}/out", f"{self.root}/checkpoint", **options)


def test_totals_go_on_after_a_restart(spark):
    feed = Feed(spark, "project_id int, xwhat string, result string, seconds double")
    feed.add((1, "a", "ok", 0.004), (1, "a", "ok", None), (2, "b", "ok", 20.0))
    feed.start(totals_stream).awaitTermination()
    feed.start(totals_stream).awaitTermination()  # nothing new
    feed.add((1, "a", "ok", 0.3))
    feed.start(totals_stream).awaitTermination()
    rows = running_totals(spark, f"{feed.root}/out").where("le in ('0.005', '0.5', '+Inf')").collect()
    found = {(r["project_id"], r["le"]): (r["events_total"], r["bucket_count"]) for r in rows}
    assert found == {
        (1, "0.005"): (3, 1), (1, "0.5"): (3, 2), (1, "+Inf"): (3, 2),
        (2, "0.005"): (1, 0), (2, "0.5"): (1, 0), (2, "+Inf"): (1, 1),
    }
    # A label set that did not change is not written again.
    written = spark.read.parquet(f"{feed.root}/out").groupBy("project_id").count().collect()
    assert {r["project_id"]: r["count"] for r in written} == {1: 2, 2: 1}


def test_nodes_turn_stale_by_the_clock(spark):
    feed = Feed(spark, NODE)
    now = int(time.time() * 1000)
    feed.add(("a", "running", "1", now), ("b", "stopped", "1", now), ("c", "running", "1", now - 60_000))
    query = feed.start(node_stream, refresh_seconds=1, interval="500ms")

    def states():
        return {r["node_id"]: r["status"] for r in node_states(spark, f"{feed.root}/out").collect()}

    try:
        until = time.time() + 60
        while time.time() < until:
            time.sleep(0.5)
            if query.lastProgress is not None and query.lastProgress["batchId"] > 0 and states().get("a") == "stale":
                break
    finally:
        query.stop()
    assert states() == {"a": "stale", "b": "stopped", "c": "stale"}


def test_nodes_come_back_and_late_heartbeats_change_nothing(spark):
    feed = Feed(spark, NODE)

    def beat(*rows):
        feed.add(*rows)
        feed.start(node_stream, refresh_seconds=1, by_event_time=True).awaitTermination()
        return {r["node_id"]: (r["status"], r["version"]) for r in node_states(spark, f"{feed.root}/out").collect()}

    assert beat(("a", "running", "1", 10_000), ("a", "running", "0", 9_000)) == {"a": ("running", "1")}
    assert beat(("b", "running", "1", 13_000))["a"] == ("running", "1")  # exactly three refreshes
    assert beat(("b", "running", "2", 13_001)) == {"a": ("stale", "1"), "b": ("running", "2")}
    assert beat(("a", "running", "2", 14_000))["a"] == ("running", "2")
    assert beat(("a", "stopped", "3", 15_000), ("b", "running", "2", 13_001))["a"] == ("stopped", "3")
    assert beat(("c", "running", "1", 90_000)) == {"a": ("stopped", "3"), "b": ("stale", "2"), "c": ("running", "1")}
