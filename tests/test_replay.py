import json

import pytest
from pyspark.sql import functions as F

from eventrail.functions.checks import Event, when
from eventrail.operators import replay
from eventrail.plans.processor import (
    Emit, EpochMs, ErrorText, Literal, ObjectValue, Request, Set, attempt, processor,
)
from eventrail.plans.standard import default_processor, enrichment_processor, loadtest_processor
from tests.frames import records, scripts

SINKS = ["events", "events_error", "loadtest_events"]
GOOD = {"appid": "a", "xwhat": "x", "xcontext": {"os": "iOS", "installid": "i", "idfa": "f"}}


def run(spark, item, *bodies, sinks=SINKS, **changes):
    """Deliveries and quarantine codes per LSN."""
    plan = replay.plan(
        records(spark, *bodies, **changes), scripts(spark, (1, "p")), {"p": item}, sinks
    )
    rows = plan.orderBy("lsn").collect()
    delivered = [
        (r["lsn"], r["sink_id"], json.loads(r["event_json"]))
        for r in replay.deliveries(plan).orderBy("lsn", "seq").collect()
    ]
    return delivered, [r["code"] for r in rows], [r["message"] for r in rows]


def test_default_routes_by_verdict(spark):
    bad = {**GOOD, "xwhat": ""}
    delivered, codes, _ = run(spark, default_processor(), GOOD, bad, "[1]", "{", "7")
    assert [(lsn, sink) for lsn, sink, _ in delivered] == [
        (1, "events"), (2, "events_error"), (3, "events_error"), (5, "events_error"),
    ]
    assert codes == [None, None, None, "replay_invalid_json_body", None]


def test_unmodified_events_keep_their_text(spark):
    text = '{"appid":"a","xwhat":"x","xcontext":{"os":"ios","installid":"i","idfa":"f","n":68.0}}'
    plan = replay.plan(
        records(spark, text), scripts(spark, (1, "p")), {"p": default_processor()}, SINKS
    )
    assert replay.deliveries(plan).first()["event_json"] == text


def test_every_quarantine_code(spark):
    strict = processor("strict", Emit("events"), Event.required("appid").string())
    lost = processor("lost", Emit("events"), Emit("nowhere"))
    frame = records(spark, GOOD).unionByName(records(spark, "{", node="m"))
    frame = frame.unionByName(records(spark, GOOD, project=2, node="o"))
    frame = frame.unionByName(records(spark, {"xwhat": "y"}, project=3, node="q"))
    frame = frame.unionByName(records(spark, {"xwhat": 5}, project=4, node="r"))
    frame = frame.unionByName(records(spark, GOOD, project=5, node="s"))
    known = scripts(spark, (1, "default"), (3, "strict"), (4, "lost"), (5, "gone"))
    plan = replay.plan(
        frame, known, {"default": default_processor(), "strict": strict, "lost": lost}, SINKS
    )
    held = {r["node_id"]: r for r in replay.quarantine(plan).collect()}
    assert {node: row["code"] for node, row in held.items()} == {
        "m": "replay_invalid_json_body", "o": "replay_unknown_project",
        "q": "replay_processor_runtime_failed", "r": "replay_unknown_sink_target",
        "s": "replay_processor_runtime_failed",
    }
    assert held["q"]["message"] == "missing required field `appid`" and held["q"]["xwhat"] == "y"
    assert held["r"]["target"] == "nowhere" and held["r"]["xwhat"] is None
    assert held["m"]["body_base64"] == "ew=="
    assert [r["node_id"] for r in replay.deliveries(plan).collect()] == ["n"]


def test_planned_blank_target_poisons_the_record(spark):
    plan = records(spark, GOOD, GOOD).withColumns({
        "__valid": F.lit(True), "xwhat": F.lit("x"), "__known": F.lit(True), "script_key": F.lit("p"),
        "processor_error": F.lit(None).cast("string"),
        "deliveries": F.array(
            F.struct(F.lit("events").alias("target"), F.col("body").alias("event_json")),
            F.struct(F.when(F.col("lsn") == 1, " ").otherwise("events").alias("target"),
                     F.col("body").alias("event_json")),
        ),
    })
    rows = replay._verdict(plan, SINKS, ["p"]).orderBy("lsn").collect()
    assert [r["code"] for r in rows] == ["replay_empty_sink_target", None]


def test_snapshots_and_order(spark):
    item = processor(
        "p", Emit("events"), Set("a.b", Literal(1)), Emit("events_error"), Set("a.c", Literal("x")),
        Set("a.b", Literal(True)), Emit("events"), Emit(" "),
    )
    delivered, codes, _ = run(spark, item, {"z": 1}, {"a": None}, {"a": {"b": 9, "k": [1]}}, {"a": 5})
    assert codes == [None, None, None, "replay_processor_runtime_failed"]
    assert [e for lsn, _, e in delivered if lsn == 1] == [
        {"z": 1}, {"a": {"b": 1}, "z": 1}, {"a": {"b": True, "c": "x"}, "z": 1},
    ]
    assert [e for lsn, _, e in delivered if lsn == 2][1] == {"a": {"b": 1}}
    assert [e for lsn, _, e in delivered if lsn == 3][2] == {"a": {"b": True, "c": "x", "k": [1]}}
    assert [sink for lsn, sink, _ in delivered if lsn == 1] == ["events", "events_error", "events"]


def test_caught_errors_keep_earlier_work(spark):
    item = processor(
        "p",
        attempt(
            Set("stage", Literal("first")), Emit("events"), Event.required("must"),
            Set("stage", Literal("second")), Emit("events"),
            catch=[Set("why", ErrorText()), Emit("events_error")],
        ),
        Event.optional("stage").string().enum(["first", "second"]),
        Emit("loadtest_events"),
    )
    delivered, codes, _ = run(spark, item, {"must": 1}, {})
    assert codes == [None, None]
    assert [(s, e.get("stage"), e.get("why")) for n, s, e in delivered if n == 1] == [
        ("events", "first", None), ("events", "second", None), ("loadtest_events", "second", None),
    ]
    reason = "missing required field `must`"
    assert [(s, e.get("stage"), e.get("why")) for n, s, e in delivered if n == 2] == [
        ("events", "first", None), ("events_error", "first", reason), ("loadtest_events", "first", reason),
    ]


def test_uncaught_error_delivers_nothing(spark):
    item = processor("p", Emit("events"), attempt(Event.required("a"), catch=[Event.required("b")]))
    delivered, codes, messages = run(spark, item, {"a": 1}, {"b": 1}, {})
    assert [lsn for lsn, _, _ in delivered] == [1, 2]
    assert codes[2] == "replay_processor_runtime_failed"
    assert messages[2] == "missing required field `b`"


def test_reads_see_rewrites(spark):
    kind = Event.field("a.kind")
    item = processor(
        "p", Set("a", ObjectValue({"kind": Literal("new"), "at": EpochMs()})),
        when(kind.eq("new"), Set("seen", Literal(True)), otherwise=[Set("seen", Literal(False))]),
        Set("copy", kind.value().upper()), Event.required("a").object(), Emit("events"),
    )
    delivered, _, _ = run(spark, item, {"a": {"kind": "old"}}, {"a": 1})
    for _, _, event in delivered:
        assert event["seen"] is True and event["copy"] == "NEW" and event["a"]["at"] > 0
    assert len(delivered) == 2


def test_enrichment_golden(spark):
    event = {"appid": "a", "xwhat": "pay", "xcontext": {"os": "iOS", "installid": "i", "currencytype": "cny"}}
    delivered, _, _ = run(spark, enrichment_processor(), event, {"appid": "a"}, {**event, "xcontext": {
        "os": "X", "installid": "i", "currencytype": 5}})
    context = delivered[0][2]["xcontext"]
    info = context.pop("process_info")
    assert delivered[0][1] == "events" and delivered[0][2]["xwhen"] == 1001
    assert context == {"os": "ios", "installid": "i", "currencytype": "CNY", "platform": "ios", "ip": "127.0.0.1"}
    assert info["receive_time"] == 1001 and "reason" not in info
    failed = delivered[1]
    assert failed[1] == "events_error"
    assert failed[2]["xcontext"]["process_info"]["reason"] == "missing required field `xwhat`"
    # An error half way keeps the rewrites made before it.
    assert delivered[2][1] == "events_error" and delivered[2][2]["xcontext"]["platform"] == "x"


def test_loadtest_marks_errors(spark):
    delivered, codes, _ = run(spark, loadtest_processor(), GOOD, {"xwhat": "x", "xcontext": None}, "[]")
    assert "loadtest_validation_code" not in delivered[0][2]["xcontext"]
    assert delivered[1][2]["xcontext"] == {"loadtest_validation_code": "rules_required_field_missing"}
    assert codes == [None, None, "replay_processor_runtime_failed"]


def test_request_values(spark):
    item = processor("p", Set("r", ObjectValue({
        "ip": Request.ip(), "m": Request.method(), "p": Request.path(), "id": Request.request_id(),
        "h": Request.header("USER-agent"), "none": Request.header("x"),
    })), Emit("events"))
    delivered, _, _ = run(spark, item, {})
    assert delivered[0][2]["r"] == {
        "ip": "127.0.0.1", "m": "POST", "p": "/ingest/p", "id": "wal-1-1", "h": "ua", "none": None,
    }


def test_python_function_has_the_same_contract(spark):
    def route(event, request, emit):
        emit("events", event)
        emit(" ", event)
        event["late"] = request.header("User-Agent")
        emit("events_error", event)
        emit("events", {"not": {1, 2}})
        if event.get("fail"):
            raise ValueError("boom")

    delivered, codes, messages = run(spark, route, {"a": 1}, {"fail": True}, "{")
    assert delivered == [(1, "events", {"a": 1}), (1, "events_error", {"a": 1, "late": "ua"})]
    assert codes == [None, "replay_processor_runtime_failed", "replay_invalid_json_body"]
    assert messages[1] == "boom"


def test_targets_are_checked_before_use():
    with pytest.raises(ValueError, match="unknown sink target `nowhere`"):
        processor("p", when(Event.field("a").exists(), Emit("nowhere"))).check_targets(["events"])
    with pytest.raises(ValueError, match="both map to constant"):
        default_processor().check_targets(["events", "Events"])
    default_processor().check_targets(["events", "events_error"])
