"""The shape of the plans: what is read, what is shuffled, how often a body is parsed."""

import re

import pytest
from pyspark.sql import functions as F

from eventrail.operators import log, metrics, replay
from eventrail.plans.queries import QUERIES
from eventrail.plans.standard import default_processor, enrichment_processor
from eventrail.session import scratch_path
from tests.frames import records, scripts


@pytest.fixture(scope="module")
def stored_log(spark):
    path = scratch_path(spark, "plans")
    log.store_batch(records(spark, *["{}"] * 20), path, 0)
    return log.read_log(spark, path)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> set[str]:
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^\n]*)>", plan))))


def test_bounds_and_gaps_never_read_bodies(stored_log):
    for df in (log.log_bounds(stored_log), log.first_gaps(stored_log)):
        assert read_columns(physical(df)) == {"lsn", "node_id"}


def test_positions_reach_the_scan(spark, stored_log):
    positions = spark.createDataFrame([("n", 7), ("m", 9)], "node_id string, start_lsn bigint")
    after = log.after_positions(stored_log, positions).select("lsn")
    assert "GreaterThan(lsn,7)" in physical(after)
    assert sorted(r["lsn"] for r in after.collect()) == list(range(8, 21))


def test_replay_is_one_stage_and_parses_once(spark, stored_log):
    for item in (default_processor(), enrichment_processor()):
        planned = replay.plan(
            stored_log, scripts(spark, (1, "p")), {"p": item}, ["events", "events_error"]
        )
        for df in (replay.deliveries(planned), replay.quarantine(planned), planned.filter("code is null")):
            plan = physical(df)
            assert "Exchange hashpartitioning" not in plan and "Exchange range" not in plan
            assert plan.count("parseJson(") - plan.count('parseJson({}') - plan.count("parseJson(null") == 1


def test_counts_combine_before_the_shuffle(spark, stored_log):
    planned = replay.plan(
        stored_log, scripts(spark, (1, "p")), {"p": default_processor()}, ["events", "events_error"]
    )
    plan = physical(metrics.delivery_totals(replay.deliveries(planned)))
    assert plan.count("partial_count") >= 1 and plan.count("Exchange hashpartitioning") == 1


def test_large_lookups_are_not_broadcast(spark, stored_log):
    from eventrail.operators.lookups import lookup_join

    nodes = spark.range(50).select(F.col("id").cast("int").alias("project_id"), F.lit("x").alias("v"))
    spread = [F.col("lsn")]
    joined = lookup_join(stored_log, nodes.hint("merge"), ["project_id"], spread=spread, limit=0)
    plan = physical(joined)
    assert "BroadcastHashJoin" not in plan and "__salt" in plan


@pytest.mark.parametrize("name", ["q_replay_targets", "q_quarantine_codes", "v_default_rule_counts"])
def test_registered_queries_read_events_once(spark, name):
    """One scan of the events, one parse of a body, and no round-robin shuffle."""
    plan = physical(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "RoundRobin" not in plan
    assert len(re.findall(r"Scan parquet.*Location[^\n]*events.parquet", plan)) <= 1
    assert plan.count("parseJson(concat(") == 1


def test_python_processors_run_in_the_same_pass(spark, stored_log):
    planned = replay.plan(
        stored_log, scripts(spark, (1, "p"), (2, "f")),
        {"p": default_processor(), "f": lambda event, request, emit: emit("events", event)},
        ["events", "events_error"],
    )
    plan = physical(planned)
    assert plan.count("Scan parquet") <= 1 and plan.count("ArrowEvalPython") == 1 and "Union" not in plan
