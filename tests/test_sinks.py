import json

import pytest
from pyspark.sql import functions as F

from eventrail.functions.names import duration_seconds, trigger_interval
from eventrail.operators.projection import ColumnSpec, check_columns, project_columns
from eventrail.session import scratch_path
from eventrail.sinks import writers
from eventrail.sinks.config import load_sinks, sink_spec

EVENT = '{"s":"x","n":1,"f":1.0,"d":2.5,"b":true,"o":{"b":1,"a":2},"l":[1],"z":null,"big":9223372036854775808}'


def deliveries(spark, *texts, sink="events"):
    rows = [("n", lsn, 0, 1, 1, sink, text) for lsn, text in enumerate(texts, start=1)]
    return spark.createDataFrame(
        rows,
        "node_id string, lsn bigint, seq int, project_id int, received_at_ms bigint, "
        "sink_id string, event_json string",
    )


def spec(path, kind, nullable=False, name="c"):
    return ColumnSpec(name, path, kind, nullable)


def test_typed_columns(spark):
    columns = [
        spec(path, kind, True, f"c{i}")
        for i, (path, kind) in enumerate([
            ("s", "string"), ("n", "number"), ("d", "number"), ("n", "integer"), ("b", "boolean"),
            ("o", "json"), ("o.a", "integer"), ("z", "string"), ("o..a", "integer"), ("$", "json"),
            ("l.0", "integer"),
        ])
    ]
    row = project_columns(deliveries(spark, EVENT), columns).first()
    assert [row[f"c{i}"] for i in range(9)] == ["x", 1.0, 2.5, 1, True, '{"a":2,"b":1}', 2, None, None]
    assert json.loads(row["c9"])["o"] == {"a": 2, "b": 1} and row["c10"] is None
    assert row["violation"] is None and row["event_json"] == EVENT


@pytest.mark.parametrize(
    ("column", "message"),
    [
        (spec("gone", "string"), "missing required parquet column `c`"),
        (spec("z", "json"), "missing required parquet column `c`"),
        (spec("n", "string", True), "parquet column `c` expected string, got number"),
        (spec("s", "number"), "parquet column `c` expected number, got string"),
        (spec("f", "integer"), "parquet column `c` expected integer, got number"),
        (spec("big", "integer"), "parquet column `c` expected integer, got number"),
        (spec("o", "boolean"), "parquet column `c` expected boolean, got object"),
        (spec("l", "string"), "parquet column `c` expected string, got array"),
        (spec("b", "integer"), "parquet column `c` expected integer, got boolean"),
    ],
)
def test_violations(spark, column, message):
    assert project_columns(deliveries(spark, EVENT), [column]).first()["violation"] == message


@pytest.mark.parametrize(
    ("columns", "with_json"),
    [
        ([], False), ([spec("a", "string"), spec("b", "string")], True),
        ([spec("a", "string", name="event_json")], True), ([spec(" ", "string")], True),
        ([spec("a", "string", name="")], True), ([spec("a", "date")], True),
    ],
)
def test_column_config_errors(columns, with_json):
    with pytest.raises(ValueError):
        check_columns(columns, with_json)


def parquet_sink(spark, columns=(), **more):
    return sink_spec(
        "events", "parquet", {"scheme": "fs", "options": {"root": scratch_path(spark, "sink")}},
        {"path_prefix": "/out/", "columns": list(columns), **more},
    )


def test_parquet_batches_are_written_once(spark):
    column = {"name": "n", "path": "n", "type": "integer"}
    sink = parquet_sink(spark, [column])
    good = deliveries(spark, '{"n":1}', '{"n":2}')
    writers.write_sink(good, sink, "0")
    writers.write_sink(good, sink, "0")
    writers.write_sink(deliveries(spark, '{"n":3}'), sink, "1")
    stored = spark.read.parquet(writers.parquet_root(sink))
    assert sorted(r["n"] for r in stored.collect()) == [1, 2, 3]
    assert stored.columns[:2] == ["n", "event_json"]
    with pytest.raises(writers.SinkFailed, match="missing required parquet column `n`"):
        writers.write_sink(deliveries(spark, '{"n":4}', "{}"), sink, "2")
    assert spark.read.parquet(writers.parquet_root(sink)).count() == 3


def test_parquet_batch_limits(spark):
    sink = parquet_sink(spark, batch={"max_events": 1})
    writers.write_sink(deliveries(spark, '{"n":1}', '{"n":2}'), sink, "0")
    names = {r["batch_name"] for r in spark.read.parquet(writers.parquet_root(sink)).collect()}
    assert len(names) == 2


def test_kafka_frame_and_options(spark):
    sink = sink_spec("events", "kafka", {"bootstrap_servers": "host:1"}, {"topic": "t"})
    row = writers.kafka_frame(deliveries(spark, '{"n":1}'), sink).first()
    assert (row["topic"], bytes(row["value"])) == ("t", b'{"n":1}')
    options = writers.kafka_options(sink)
    assert (options["kafka.compression.type"], options["kafka.linger.ms"]) == ("snappy", "100")
    patient = sink_spec(
        "events", "kafka", {"bootstrap_servers": "h", "queue_buffering_max_ms": "250"}, {"topic": "t"}
    )
    assert writers.kafka_options(patient)["kafka.linger.ms"] == "250"
    with pytest.raises(writers.SinkFailed):
        writers.write_sink(deliveries(spark, "{}"), sink, "0")


def test_other_sinks(spark):
    assert writers.stdout_lines(deliveries(spark, "{}")).first()["value"] == "{}"
    writers.write_sink(deliveries(spark, "{}"), sink_spec("b", "blackhole"), "0")
    writers.write_sink(deliveries(spark, "{}"), sink_spec("s", "stdout"), "0")
    failing = sink_spec("b", "blackhole", {}, {"mode": "fail"})
    with pytest.raises(writers.SinkFailed, match="replay_sink_send_failed: sink `b`"):
        writers.write_sink(deliveries(spark, "{}"), failing, "0")


FS = {"scheme": "fs", "options": {"root": "/x"}}


@pytest.mark.parametrize(
    "args",
    [
        ("a b", "stdout"), ("a", "nothing"), ("a", "stdout", {"x": 1}),
        ("a", "kafka", {}, {"topic": "t"}), ("a", "kafka", {"bootstrap_servers": "h"}, {}),
        ("a", "kafka", {"bootstrap_servers": "h", "acks": "1"}, {"topic": "t"}),
        ("a", "kafka", {"bootstrap_servers": " "}, {"topic": "t"}),
        ("a", "parquet", {"scheme": "ftp", "options": {"a": 1}}, {"path_prefix": "p"}),
        ("a", "parquet", {"scheme": "fs", "options": {}}, {"path_prefix": "p"}),
        ("a", "parquet", FS, {}), ("a", "parquet", FS, {"path_prefix": "p", "extra": 1}),
        ("a", "parquet", FS, {"path_prefix": "p", "columns": [{"name": "a", "path": "b"}]}),
        ("a", "stdout", {}, {"batch": {"max_events": 0}}),
        ("a", "stdout", {}, {"batch": {"timeout": "soon"}}),
        ("a", "blackhole", {}, {"mode": "odd"}), ("a", "stdout", {}, {}, "middle"),
        ("a", "blackhole", {}, {"mode": "slow"}), ("a", "blackhole", {}, {"delay_ms": 5}),
        ("a", "stdout", {}, {"batch": {"max_events": -5}}), ("a", "stdout", {}, {"batch": {"max_bytes": "5"}}),
        ("a", "kafka", {"bootstrap_servers": "h", "batch_num_messages": "7"}, {"topic": "t"}),
        ("a", "parquet", {"scheme": "memory", "options": {"root": "/x"}}, {"path_prefix": "p"}),
        ("a", "parquet", {"scheme": "s3", "options": {"bucket": "b", "acl": "x"}}, {"path_prefix": "p"}),
        ("a", "parquet", {"scheme": "s3", "options": {"root": "/x"}}, {"path_prefix": "p"}),
    ],
)
def test_sink_config_errors(args):
    with pytest.raises(ValueError):
        sink_spec(*args)


def test_object_store_roots():
    target = {"scheme": "s3", "options": {"bucket": "b", "root": "/r"}}
    assert writers.parquet_root(sink_spec("k", "parquet", target, {"path_prefix": "p"})) == "s3a://b/r/p/k"


def test_object_store_options():
    options = {"bucket": "b", "endpoint": "e", "region": "r", "access_key_id": "k", "secret_access_key": "s"}
    sink = sink_spec("k", "parquet", {"scheme": "s3", "options": options}, {"path_prefix": "p"})
    assert writers.storage_options(sink) == {
        "fs.s3a.endpoint": "e", "fs.s3a.endpoint.region": "r", "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s",
    }


def test_limits_above_the_window(spark):
    sink = parquet_sink(spark, batch={"max_events": 5000})
    writers.write_sink(deliveries(spark, *["{}"] * 5000), sink, "0")
    stored = spark.read.parquet(writers.parquet_root(sink))
    assert [r["count"] for r in stored.groupBy("batch_name").count().collect()] == [5000]
    assert "batch_name=" not in "".join(stored.inputFiles())


def test_sinks_are_loaded_from_the_config_tables(spark):
    table = spark.createDataFrame(
        [("b", "stdout", "{}", "{}", "earliest"), ("a", "blackhole", "{}", '{"batch":{"max_events":5}}', None)],
        "sink_id string, target_type string, config_json string, destination_json string, auto_offset_reset string",
    )
    sinks = load_sinks(table)
    assert list(sinks) == ["a", "b"]
    assert sinks["a"].batch.max_events == 5 and sinks["b"].auto_offset_reset == "earliest"


def test_durations():
    assert [duration_seconds(t) for t in ("0s", "5s", "1m", "1h 30m", "10ms")] == [0, 5, 60, 5400, 0.01]
    assert trigger_interval("1m 500ms") == "60500 milliseconds"
    for text in ("", "5", "5 parsecs", "x5s"):
        with pytest.raises(ValueError):
            duration_seconds(text)


def test_names(spark):
    from eventrail.functions.names import is_plain_id, project_key, sink_constant, sink_constant_name

    ids = ["kafka-mutated", "a..b__", "-x", "é", "events"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(
        "id", sink_constant(F.col("id")).alias("c"), is_plain_id(F.col("id")).alias("p")
    ).collect()
    assert [r["c"] for r in rows] == ["SINK_KAFKA_MUTATED", "SINK_A_B", "SINK__X", "SINK", "SINK_EVENTS"]
    assert [r["c"] for r in rows] == [sink_constant_name(i) for i in ids]
    assert [r["p"] for r in rows] == [True, True, True, False, True]
    keys = spark.createDataFrame([(" My App! ",), ("a- b",), ("!!",), ("a  b",)], "n string")
    assert [r["k"] for r in keys.select(project_key(F.col("n")).alias("k")).collect()] == [
        "My-App", "a--b", None, "a-b",
    ]
