"""The query catalogue: every operator over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.functions import jsonx, names
from eventrail.functions.checks import Event, classify_error, when
from eventrail.functions.extract import with_conditions, with_error
from eventrail.operators import (
    admit,
    batching,
    config,
    decode,
    log,
    metrics,
    projection,
    replay,
)
from eventrail.plans.lint import findings, sink_names
from eventrail.plans.processor import Emit, Processor, Request, Set, attempt, processor
from eventrail.plans.processor import Literal as Value
from eventrail.plans.standard import (
    default_checks,
    default_processor,
    enrichment_processor,
    loadtest_processor,
    standard_rule_book,
)
from eventrail.session import scratch_path
from eventrail.sinks.config import BatchLimits, sink_spec
from eventrail.sinks.writers import kafka_frame, stdout_lines, write_parquet
from eventrail.sources import derived
from eventrail.streaming import metrics as stream_metrics
from eventrail.streaming.replay import Progress, ReplayConfig, SmallBatches, replay_stream

Query = Callable[[SparkSession, str], DataFrame]
SINKS = ["events", "events_error", "loadtest_events"]
CHECKPOINT_EVERY = 3


def parsed_log(spark: SparkSession, folder: str) -> DataFrame:
    return jsonx.parse_strict(derived.record_log(spark, folder), "body")


def strict_processor() -> Processor:
    """Uncaught checks: a failing event is quarantined."""
    return processor(
        "strict", Emit("events"), Event.required("appid").string(), Event.required("xwho").string()
    )


def lost_processor() -> Processor:
    """Emits some events to a sink nobody configured."""
    startup = Event.field("xwhat").eq("startup")
    return processor("lost", Emit("events"), when(startup, Emit("nowhere")))


def all_processors() -> dict[str, Processor]:
    built = [
        default_processor(), strict_processor(), lost_processor(), loadtest_processor(),
        enrichment_processor(),
    ]
    return {item.key: item for item in built}


def project_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return config.project_scripts(
        derived.projects(spark, folder), derived.scripts(spark, folder),
        derived.bindings(spark, folder),
    )


def default_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return config.enabled(derived.projects(spark, folder)).select(
        F.col("id").alias("project_id"), F.lit("default").alias("script_key")
    )


def planned(spark: SparkSession, folder: str) -> DataFrame:
    return replay.plan(
        derived.record_log(spark, folder), project_scripts(spark, folder), all_processors(), SINKS
    )


def planned_default(spark: SparkSession, folder: str) -> DataFrame:
    return replay.plan(
        derived.record_log(spark, folder),
        default_scripts(spark, folder),
        {"default": default_processor()},
        SINKS,
    )


def checked_requests(spark: SparkSession, folder: str) -> DataFrame:
    return admit.admit(derived.requests(spark, folder), derived.projects(spark, folder))


# Validation ------------------------------------------------------------------


def default_rules(spark, folder):
    return with_error(parsed_log(spark, folder), default_checks()).select(
        "lsn",
        F.when(F.col("event").isNull(), "bad json")
        .otherwise(F.coalesce("error", F.lit("ok")))
        .alias("verdict"),
    )


def default_rule_counts(spark, folder):
    """Rows per target and first error: the flagship query."""
    verdicts = default_rules(spark, folder)
    target = (
        F.when(F.col("verdict") == "ok", "events")
        .when(F.col("verdict") == "bad json", "quarantine")
        .otherwise("events_error")
    )
    return verdicts.groupBy(target.alias("target"), "verdict").agg(F.count("*").alias("records"))


def rule_book(spark, folder):
    steps = standard_rule_book().steps()
    return (
        with_error(parsed_log(spark, folder), steps)
        .filter(F.col("event").isNotNull())
        .select("lsn", F.coalesce("error", F.lit("ok")).alias("verdict"))
    )


def error_codes(spark, folder):
    checked = with_error(parsed_log(spark, folder), default_checks())
    coded = checked.filter(F.col("event").isNotNull() & F.col("error").isNotNull())
    return coded.groupBy(classify_error(F.col("error")).alias("code")).agg(
        F.count("*").alias("records")
    )


def _typed_body() -> F.Column:
    """A value whose JSON kind follows the event id."""
    e = F.col("event_id")
    value = (
        F.when(e % 7 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(e % 7 == 1, e.cast("string"))
        .when(e % 7 == 2, F.concat(e.cast("string"), F.lit(".0")))
        .when(e % 7 == 3, F.lit("true"))
        .when(e % 7 == 4, F.concat(F.lit('{"a":'), e.cast("string"), F.lit("}")))
        .when(e % 7 == 5, F.concat(F.lit("["), e.cast("string"), F.lit("]")))
        .otherwise(F.lit("null"))
    )
    member = F.concat(F.lit('{"v":'), value, F.lit("}"))
    return F.when(e % 10 == 9, F.lit("{}")).otherwise(member)


def _typed(spark, folder):
    rows = derived.events(spark, folder).select("event_id", _typed_body().alias("body"))
    return jsonx.parse_strict(rows, "body")


def value_types(spark, folder):
    df = _typed(spark, folder)
    for name in ("string", "number", "integer", "boolean", "object", "array"):
        df = with_error(df, [getattr(Event.optional("v"), name)()], out=f"{name}_error")
    return df.drop("event", "body")


def required_fields(spark, folder):
    df = with_error(_typed(spark, folder), [Event.required("v")], out="required_error")
    df = with_error(df, [Event.any(["v", "w"]).required()], out="any_error")
    df = with_error(df, [Event.field("v"), Event.optional("w")], out="optional_error")
    return df.drop("event", "body")


def predicates(spark, folder):
    v = Event.field("v")
    conditions = {
        "is_purchase": v.eq("purchase"),
        "is_purchase_folded": v.ignore_case().eq("PURCHASE"),
        "is_eight": v.eq(8),
        "is_nine_float": v.eq(9.0),
        "is_true": v.eq(True),
        "is_list": v.eq([5]),
        "is_null": v.eq(None),
        "present": v.exists(),
        "absent": v.missing(),
        "has_key": Event.contains("v"),
        "either": v.eq("view") | (v.eq(True) & v.exists()),
    }
    return with_conditions(_typed(spark, folder), conditions).drop("event", "body")


def field_values(spark, folder):
    value = jsonx.get(F.col("event"), '$["v"]')
    return _typed(spark, folder).select("event_id", F.to_json(value).alias("value"))


def number_limits(spark, folder):
    """Comparisons as double over numbers, and over text that only looks like one."""
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"n":'),
        F.when(e % 5 == 0, F.concat(F.lit('"'), e.cast("string"), F.lit('"')))
        .otherwise((e % 100).cast("string")),
        F.lit("}"),
    )
    df = jsonx.parse_strict(derived.events(spark, folder).select("event_id", body.alias("body")), "body")
    n = Event.required("n")
    checks = {"gt": n.gt(50), "gte": n.gte(50.5), "lt": n.lt(25), "lte": n.number().lte(75)}
    for name, check in checks.items():
        df = with_error(df, [check], out=f"{name}_error")
    return df.drop("event", "body")


def text_rules(spark, folder):
    """Length, membership and pattern over whole documents."""
    docs = derived.table(spark, folder, "documents")
    body = F.to_json(F.struct("lang", F.upper("source").alias("source"), "text"))
    df = jsonx.parse_strict(docs.select("doc_id", body.alias("body")), "body")
    text, lang, source = (Event.required(n).string() for n in ("text", "lang", "source"))
    checks = {
        "length": text.min(1000),
        "lang": lang.enum(["en", "fr"]),
        "source": source.ignore_case().enum(["src0", "src1"]),
        "one_of": Event.field("lang").one_of(["DE", "Fr"]),
        "digit": text.matches("[0-9]"),
        "start": source.ignore_case().matches("^src[02]$"),
    }
    for name, check in checks.items():
        df = with_error(df, [check], out=f"{name}_error")
    return df.drop("event", "body")


DATE_FORMATS = {"day_of_year": "%Y-%j", "named_month": "%d %b %Y", "american": "%m/%d/%y"}
DATE_PATTERNS = {"day_of_year": "yyyy-DDD", "named_month": "dd MMM yyyy", "american": "MM/dd/yy"}


def date_formats(spark, folder):
    """Order dates and times in several spellings; every third text has a digit too many."""
    o = F.col("o_orderkey")
    extra = F.when(o % 3 == 0, "0").otherwise("")
    fields = {
        name: F.concat(F.date_format("o_orderdate", pattern), extra).alias(name)
        for name, pattern in DATE_PATTERNS.items()
    }
    hour = F.concat(F.lpad((o % 16).cast("string"), 2, "0"), F.lit(":05 "), F.when(o % 2 == 0, "AM").otherwise("PM"))
    body = F.to_json(F.struct(*fields.values(), hour.alias("half_day")))
    df = derived.table(spark, folder, "orders").select("o_orderkey", body.alias("body"))
    df = jsonx.parse_strict(df, "body")
    checks = {name: Event.field(name).string().date(text) for name, text in DATE_FORMATS.items()}
    checks["half_day"] = Event.field("half_day").string().time("%I:%M %p")
    for name, check in checks.items():
        df = with_error(df, [check], out=name)
    return df.select("o_orderkey", *[F.col(name).isNull().alias(name) for name in checks])


REGEXES = {
    "alpha": "^[[:alpha:]]+$",
    "not_digit": "^[^[:digit:]]+$",
    "greek": r"^\p{Greek}+$",
    "han": r"^[\p{Han}]+$",
    "upper": r"^\p{Lu}",
    "word_end": r"\d$",
}


def regex_dialect(spark, folder):
    """POSIX classes, scripts and categories, on texts of several alphabets."""
    e = F.col("event_id")
    words = F.array(*map(F.lit, ["abc", "αβγ", "漢字", "Été", "x1", "7\n", "ABC"]))
    body = F.to_json(F.struct(F.get(words, (e % 7).cast("int")).alias("s")))
    df = jsonx.parse_strict(derived.events(spark, folder).select("event_id", body.alias("body")), "body")
    for name, pattern in REGEXES.items():
        df = with_error(df, [Event.field("s").string().matches(pattern)], out=name)
    folded = Event.field("s").string().ignore_case().matches("^abc$")
    df = with_error(df, [folded], out="folded")
    return df.select("event_id", *[F.col(name).isNull().alias(name) for name in [*REGEXES, "folded"]])


LONG_REGEXES = {
    "pairs": "^(x|y)+$",
    "prose": r"^(?:[\pL'-]+[ .,;:!?\n]*|[^\pL])*$",
    "capitals": r"(?:\p{Lu}\p{Ll}+ )+\p{Ll}+\.",
    "doubled": r"(a|aa)+(e|ee)+[rst]+[ ,]",
    "mail": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+",
    "licensed": r"(?i)licen[cs]e(?:.|\n)*(?:copy|warrant)[a-z]*",
    "lines": r"^(?:.*\n)+.*$",
    "words": r"^(?:[^ ]+ ){5,9}[^ ]+$",
}


def long_regexes(spark, folder):
    """Repeated groups over whole documents, and over the longest body that is let in."""
    docs = derived.table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    most = spark.createDataFrame([(-1,)], "doc_id long").select("doc_id", F.repeat(F.lit("xy"), 131_072).alias("text"))
    body = F.to_json(F.struct(F.col("text").alias("s")))
    df = jsonx.parse_strict(docs.unionAll(most).select("doc_id", body.alias("body")), "body")
    for name, pattern in LONG_REGEXES.items():
        df = with_error(df, [Event.field("s").string().matches(pattern)], out=name)
    return df.select("doc_id", *[F.col(name).isNull().alias(name) for name in LONG_REGEXES])


EQUALS = {
    "ints": [1, 2],
    "floats": [1.0, 2],
    "nested": {"a": [1, {"b": None}], "c": "x"},
    "one": 1,
    "one_float": 1.0,
    "empty": [],
}


def json_equality(spark, folder):
    """Equality of whole values: by kind and value of every leaf, whatever the key order."""
    e = F.col("event_id")
    values = ["[1,2]", "[1.0,2]", '{"c":"x","a":[1,{"b":null}]}', '{"c":"x","a":[1,{}]}', "1", "1.0", "[]", "{}",
              "[1,2,3]", "null"]
    value = F.get(F.array(*map(F.lit, values)), (e % 10).cast("int"))
    body = F.concat(F.lit('{"v":'), value, F.lit("}"))
    df = jsonx.parse_strict(derived.events(spark, folder).select("event_id", body.alias("body")), "body")
    conditions = {name: Event.field("v").eq(wanted) for name, wanted in EQUALS.items()}
    return with_conditions(df, conditions).select("event_id", *EQUALS)


NON_OBJECT_PROCESSORS = {
    "emits": (Emit("events"),),
    "branches": (Emit("events"), when(Event.field("xwhat").eq("startup"), Emit("events_error"))),
    "checks": (Event.required("xwhat"), Emit("events")),
    "sets": (Set("a", Event.field("xwhat").value()), Emit("events")),
    "catches": (
        attempt(when(Event.field("xwhat").eq("startup"), Emit("events")), catch=[Emit("events_error")]),
    ),
}


def non_objects(spark, folder):
    """Arrays and scalars through every kind of processor: rows per target or reason."""
    e = F.col("lsn") % 6
    bodies = F.array(*map(F.lit, ["[1]", '"x"', "7", "null", "true"]))
    records = derived.record_log(spark, folder).withColumn(
        "body", F.when(e < 5, F.get(bodies, e.cast("int"))).otherwise('{"xwhat":"startup"}')
    ).withColumn("project_id", (F.col("lsn") % 5).cast("int"))
    names = list(NON_OBJECT_PROCESSORS)
    scripts = spark.createDataFrame(list(enumerate(names)), "project_id int, script_key string")
    processors = {name: processor(name, *steps) for name, steps in NON_OBJECT_PROCESSORS.items()}
    planned = replay.plan(records, scripts, processors, SINKS)
    rows = replay.deliveries(planned).select("project_id", F.col("sink_id").alias("outcome")).unionByName(
        planned.where("code is not null").select("project_id", F.concat_ws(": ", "code", "message").alias("outcome"))
    )
    script = F.get(F.array(*map(F.lit, names)), F.col("project_id"))
    return rows.groupBy(script.alias("script"), "outcome").agg(F.count("*").alias("records"))


def temporal_rules(spark, folder):
    """Order dates spelled well and badly."""
    orders = derived.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = F.col("o_orderkey")
    spelled = (
        F.when(o % 5 == 0, F.date_format("o_orderdate", "yyyy-M-d"))
        .when(o % 7 == 0, F.concat(F.substring(day, 1, 8), F.lit("30")))
        .otherwise(day)
    )
    clock = F.concat_ws(
        ":", F.lpad((o % 26).cast("string"), 2, "0"), F.lpad((o % 60).cast("string"), 2, "0"),
        F.lit("07"),
    )
    body = F.to_json(
        F.struct(
            spelled.alias("d"), clock.alias("t"), F.concat_ws(" ", spelled, clock).alias("dt")
        )
    )
    df = jsonx.parse_strict(orders.select("o_orderkey", body.alias("body")), "body")
    d, t, dt = (Event.required(name).string() for name in ("d", "t", "dt"))
    df = with_error(df, [d.date("%Y-%m-%d")], out="date_error")
    df = with_error(df, [t.time("%H:%M:%S")], out="time_error")
    df = with_error(df, [dt.datetime("%Y-%m-%d %H:%M:%S")], out="datetime_error")
    return df.drop("event", "body")


# Decoding and admission ------------------------------------------------------


def decoded_requests(spark, folder):
    return decode.decode(derived.requests(spark, folder)).select(
        "request_seq", "decoder", "decode_issue", "body_token",
        F.when(F.col("decode_issue").isNull(), F.col("event_text")).alias("event_text"),
    )


def decoded_spellings(spark, folder):
    """Bodies with every kind of token member, number spelling and key order."""
    return decode.decode(derived.spelled_requests(spark, folder)).select(
        "request_seq", "decode_issue",
        *[F.when(F.col("decode_issue").isNull(), F.col(c)).alias(c) for c in ("body_token", "event_text")],
    )


def page_queries(spark, folder):
    """Query strings of page URLs as events."""
    pages = derived.table(spark, folder, "pages")
    query = F.when(F.instr("url", "?") > 0, F.regexp_extract("url", r"\?(.*)$", 1))
    return pages.select(
        "page_id", decode.pairs_object(decode.url_pairs(query)).alias("event_text")
    )


def issue_counts(spark, folder):
    return (
        checked_requests(spark, folder)
        .groupBy(F.coalesce("issue_code", F.lit("admitted")).alias("issue"))
        .agg(F.count("*").alias("requests"))
    )


def rejected_requests(spark, folder):
    return admit.rejections(checked_requests(spark, folder)).select(
        "request_seq", "project_key", "issue_code", "status", "message"
    )


def admitted_log(spark, folder):
    """Admitted requests with gapless LSNs per node."""
    numbered = log.assign_lsns(admit.admitted(checked_requests(spark, folder)))
    return numbered.select(
        "node_id", "lsn", "record_id", "project_id", "method", F.size("headers").alias("headers"),
        "body",
    )


def size_cap(spark, folder):
    checked = admit.admit(
        derived.documents_as_requests(spark, folder), derived.projects(spark, folder), 8192
    )
    return checked.select("request_seq", "issue_code", "event_name")


# Log -------------------------------------------------------------------------


def log_scan(spark, folder):
    return derived.record_log(spark, folder).select("node_id", "lsn", "record_id", "body")


def many_node_log(spark, folder):
    """The log spread over nodes: LSN 1.. of a node is its events in order."""
    records = derived.events(spark, folder).select(
        F.concat(F.lit("node-"), F.col("user_id") % 3).alias("node_id"),
        F.col("event_id").alias("request_seq"),
        F.col("event_id").alias("received_at_ms"),
        F.col("user_id").cast("int").alias("project_id"),
        F.lit("POST").alias("method"),
        F.lit("/").alias("path"),
        F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("string").alias("remote_addr"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.lit("{}").alias("body"),
    )
    return log.assign_lsns(records)


def log_checkpoints(bounds: DataFrame) -> DataFrame:
    """A checkpoint a third into each node's log, none for the last node."""
    third = F.floor(F.col("tail_lsn") / CHECKPOINT_EVERY).cast("bigint")
    return bounds.filter(F.col("node_id") != "node-2").select(
        "node_id", third.alias("checkpoint_lsn")
    )


def log_bounds(spark, folder):
    return log.log_bounds(many_node_log(spark, folder))


def start_positions(spark, folder):
    bounds = log.log_bounds(many_node_log(spark, folder))
    return log.start_positions(
        bounds, log_checkpoints(bounds), derived.event_sinks(spark, folder)
    )


def log_after_checkpoint(spark, folder):
    records = many_node_log(spark, folder)
    bounds = log.log_bounds(records)
    positions = log.start_positions(
        bounds, log_checkpoints(bounds), derived.event_sinks(spark, folder)
    )
    return log.after_positions(records, positions, limit=100).select("node_id", "lsn", "record_id")


def _broken_log(spark, folder):
    """The log without some records: every node loses one at a different place."""
    records = derived.events(spark, folder)
    node = F.concat(F.lit("node-"), (F.col("event_id") % 4).cast("string"))
    lsn = F.floor(F.col("event_id") / 4) + 1
    lost = ((F.col("event_id") % 4 == 1) & (lsn % 50 == 0)) | (
        (F.col("event_id") % 4 == 2) & lsn.isin(40, 41)
    )
    return records.select(node.alias("node_id"), lsn.cast("bigint").alias("lsn"), lost.alias("lost"))


def lsn_gaps(spark, folder):
    broken = _broken_log(spark, folder).filter(~F.col("lost")).select("node_id", "lsn")
    return log.first_gaps(broken)


def before_gap(spark, folder):
    broken = _broken_log(spark, folder).filter(~F.col("lost")).select("node_id", "lsn")
    return log.before_gaps(broken, log.first_gaps(broken))


# Configuration ---------------------------------------------------------------


def enabled_config(spark, folder):
    return config.admission_projects(derived.projects(spark, folder)).select(
        "project_id", "project_key", "auth_mode", F.array_join("allowed_ips", ",").alias("ips")
    )


def request_projects(spark, folder):
    checked = checked_requests(spark, folder)
    return checked.groupBy("project_id").agg(F.count("*").alias("requests"))


def known_projects(spark, folder):
    counts = planned_default(spark, folder).filter(
        F.col("code").isNull() | (F.col("code") != "replay_invalid_json_body")
    )
    unknown = F.coalesce(F.col("code") == "replay_unknown_project", F.lit(False))
    return counts.groupBy("project_id", unknown.alias("unknown")).agg(F.count("*").alias("records"))


def runtime_sinks(spark, folder):
    return config.runtime_sinks(
        derived.event_sinks(spark, folder), derived.delivery_targets(spark, folder)
    ).select("sink_id", "target_id", "target_type", "auto_offset_reset")


def delivery_sinks(spark, folder):
    s = F.col("event_id") % 120
    sink = F.concat(
        F.lit("sink"), F.when(s % 2 == 0, "-").otherwise("_."), (s - s % 3).cast("string"),
        F.when(s % 3 == 1, "-").when(s % 3 == 2, "x").otherwise(""),
    )
    planned_deliveries = derived.events(spark, folder).select(
        F.lit("node-a").alias("node_id"), (F.col("event_id") + 1).alias("lsn"),
        F.when(F.col("event_id") % 37 == 0, " ").otherwise(sink).alias("sink_id"),
    )
    runtime = config.runtime_sinks(
        derived.event_sinks(spark, folder), derived.delivery_targets(spark, folder)
    )
    return config.match_targets(planned_deliveries, runtime).select("lsn", "sink_id", "code")


def default_bindings(spark, folder):
    return config.missing_default_bindings(
        derived.projects(spark, folder), derived.scripts(spark, folder),
        derived.bindings(spark, folder),
    )


def dangling_sinks(spark, folder):
    return config.dangling_sinks(
        derived.event_sinks(spark, folder), derived.delivery_targets(spark, folder)
    )


def sink_constants(spark, folder):
    return config.sink_constants(derived.event_sinks(spark, folder))


def project_keys(spark, folder):
    """Keys of page URLs and part names taken as project names."""
    pages = derived.table(spark, folder, "pages").select(F.col("url").alias("name"))
    parts = derived.table(spark, folder, "part").select(
        F.concat(F.lit(" "), F.col("p_name"), F.lit("- "), F.col("p_brand"), F.lit("!")).alias("name")
    )
    both = pages.unionByName(parts)
    return both.select("name", names.project_key(F.col("name")).alias("project_key"))


def plain_ids(spark, folder):
    suppliers = derived.table(spark, folder, "supplier")
    ids = suppliers.select(F.col("s_name").alias("id")).unionByName(
        derived.event_sinks(spark, folder).select(F.col("sink_id").alias("id"))
    )
    return ids.select("id", names.is_plain_id(F.col("id")).alias("plain"))


# Replay ----------------------------------------------------------------------


def replay_targets(spark, folder):
    return (
        replay.deliveries(planned_default(spark, folder))
        .groupBy("sink_id")
        .agg(F.count("*").alias("records"))
    )


def quarantine_codes(spark, folder):
    return metrics.quarantine_totals(replay.quarantine(planned(spark, folder)))


def quarantine_records(spark, folder):
    return replay.quarantine(planned_default(spark, folder)).select(
        "code", "action", "record_id", "lsn", "received_at_ms", "path", "xwhat", "target",
        "message", "error", "body_base64",
    )


def project_processors(spark, folder):
    return (
        replay.deliveries(planned(spark, folder))
        .groupBy("project_id", "sink_id")
        .agg(F.count("*").alias("records"))
    )


def _rewriting_scripts(spark, folder, key):
    return config.enabled(derived.projects(spark, folder)).select(
        F.col("id").alias("project_id"), F.lit(key).alias("script_key")
    )


def loadtest_codes(spark, folder):
    """Events that went wrong carry the code of their error."""
    plan = replay.plan(
        derived.record_log(spark, folder), _rewriting_scripts(spark, folder, "loadtest"),
        {"loadtest": loadtest_processor()}, SINKS,
    )
    code = F.get_json_object("event_json", "$.xcontext.loadtest_validation_code")
    return replay.deliveries(plan).select("lsn", "sink_id", code.alias("validation_code"))


def enriched_events(spark, folder):
    plan = replay.plan(
        derived.record_log(spark, folder), _rewriting_scripts(spark, folder, "enrichment"),
        {"enrichment": enrichment_processor()}, SINKS,
    )
    fields = {
        "os": "$.xcontext.os", "platform": "$.xcontext.platform", "ip": "$.xcontext.ip",
        "currencytype": "$.xcontext.currencytype",
        "receive_time": "$.xcontext.process_info.receive_time",
        "reason": "$.xcontext.process_info.reason", "xwhen": "$.xwhen",
    }
    read = [F.get_json_object("event_json", path).alias(name) for name, path in fields.items()]
    return replay.deliveries(plan).select("lsn", "sink_id", *read)


def emit_snapshots(spark, folder):
    """Every emit keeps the event as it was; the order of emits is kept."""
    item = processor(
        "snapshots",
        Emit("events"),
        Set("xcontext.stage", Value("late")),
        when(Event.field("xwhat").eq("payment"), Emit("events_error")),
        Set("xwhat", Value("seen")),
        Emit("loadtest_events"),
    )
    plan = replay.plan(
        derived.record_log(spark, folder), _rewriting_scripts(spark, folder, "snapshots"),
        {"snapshots": item}, SINKS,
    )
    return replay.deliveries(plan).select(
        "lsn", "seq", "sink_id",
        F.get_json_object("event_json", "$.xwhat").alias("xwhat"),
        F.get_json_object("event_json", "$.xcontext.stage").alias("stage"),
    )


def python_processor(spark, folder):
    """The same routing as a Python function."""

    def route(event, request, emit):
        if "appid" not in event:
            raise ValueError("no appid")
        emit("events", event)
        if event["xwhat"] == "payment":
            emit("events_error", {"id": request.request_id, "ua": request.header("USER-AGENT")})

    plan = replay.plan(
        derived.record_log(spark, folder), _rewriting_scripts(spark, folder, "route"),
        {"route": route}, SINKS,
    )
    bad = replay.quarantine(plan).select(
        "lsn", F.lit("quarantine").alias("sink_id"), F.lit(-1).alias("seq"), F.col("code").alias("note")
    )
    good = replay.deliveries(plan).select(
        "lsn", "sink_id", "seq", F.get_json_object("event_json", "$.ua").alias("note")
    )
    return good.unionByName(bad)


NAMES = sink_names(SINKS)


def target_lint(spark, folder):
    """What activation says of the script of every project, were these its processors."""

    def by_constant(event, request, emit):
        emit(NAMES.SINK_EVENTS, event)

    def by_text(event, request, emit):
        emit("events", event)

    def computed(event, request, emit):
        emit(event["target"], event)

    built = {
        "default": by_constant, "strict": by_text, "lost": lost_processor(), "loadtest": computed,
        "enrichment": enrichment_processor(),
    }
    said = [(key, message.partition(" (line")[0]) for key, message in findings(built, SINKS)]
    messages = spark.createDataFrame(said, "script_key string, message string")
    # One row for each finding of five scripts.
    return project_scripts(spark, folder).join(F.broadcast(messages), "script_key", "left").select(
        "project_id", "script_key", "message"
    )


def _all_scripts(spark, folder, key):
    """Every project of the log under one processor."""
    users = derived.events(spark, folder).select(F.col("user_id").cast("int").alias("project_id"))
    return users.distinct().withColumn("script_key", F.lit(key))


def request_values(spark, folder):
    """What a processor reads of the request, set as fields of an empty event."""
    steps = {
        "ip": Request.ip(), "method": Request.method(), "path": Request.path(),
        "request_id": Request.request_id(), "received_at_ms": Request.received_at_ms(),
        "user_agent": Request.header("User-AGENT"),
    }
    reader = processor("reader", *[Set(name, value) for name, value in steps.items()], Emit("events"))
    records = derived.record_log(spark, folder).withColumn("body", F.lit("{}"))
    planned = replay.plan(records, _all_scripts(spark, folder, "reader"), {"reader": reader}, SINKS)
    field = {name: F.get_json_object("event_json", f"$.{name}") for name in steps}
    field["received_at_ms"] = field["received_at_ms"].cast("bigint")
    return replay.deliveries(planned).select("lsn", *[c.alias(n) for n, c in field.items()])


def created_containers(spark, folder):
    """A rewrite below fields that are missing, null, objects or something else."""
    kinds = F.array(*map(F.lit, ["{}", '{"made":null}', '{"made":{"kept":1}}', '{"made":7}', '{"made":{"deep":[]}}']))
    records = derived.record_log(spark, folder).withColumn("body", F.get(kinds, (F.col("lsn") % 5).cast("int")))
    maker = processor("maker", Set("made.deep.value", Request.method()), Emit("events"))
    planned = replay.plan(records, _all_scripts(spark, folder, "maker"), {"maker": maker}, SINKS)
    good = replay.deliveries(planned).select("lsn", F.col("event_json").alias("outcome"))
    return good.unionByName(planned.where("code is not null").select("lsn", F.col("message").alias("outcome")))


# Sinks -----------------------------------------------------------------------

FILES = {"scheme": "fs", "options": {"root": "/data"}}
# Type, target, destination; every second one is refused.
SINK_CASES = [
    ("parquet", FILES, {"path_prefix": "out", "batch": {"timeout": "1m 30s"}}),
    ("parquet", FILES, {"path_prefix": " "}),
    ("kafka", {"bootstrap_servers": "b:9092"}, {"topic": "t"}),
    ("kafka", {}, {"topic": "t"}),
    ("blackhole", {}, {"mode": "ok"}),
    ("blackhole", {}, {"mode": "slow"}),
    ("stdout", {}, {}),
    ("stdout", {}, {"batch": {"max_events": 0}}),
    ("parquet", {"scheme": "s3", "options": {"bucket": "b"}}, {"path_prefix": "p"}),
    ("parquet", {"scheme": "ftp", "options": {"root": "/"}}, {"path_prefix": "p"}),
]


def sink_refusals(spark, folder):
    """What is wrong with the configuration of each sink, nothing for a good one."""
    rows = []
    for row in derived.event_sinks(spark, folder).select("id", "auto_offset_reset").toLocalIterator():
        kind, target, destination = SINK_CASES[row["id"] % len(SINK_CASES)]
        try:
            sink_spec(f"s{row['id']}", kind, target, destination, row["auto_offset_reset"])
            rows.append((row["id"], None))
        except ValueError as refused:
            rows.append((row["id"], str(refused)))
    return spark.createDataFrame(rows, "id bigint, error string")


def durations(spark, folder):
    """Seconds of duration texts, one for each sink; texts that are none have no seconds."""
    s = F.col("id")
    texts = F.array(
        F.concat(s.cast("string"), F.lit("ms")), F.concat(s.cast("string"), F.lit("s")),
        F.concat(s.cast("string"), F.lit("min 30sec")), F.concat(s.cast("string"), F.lit("h 1m 2s")),
        F.concat(F.lit("1day "), s.cast("string"), F.lit("hours")), F.concat(s.cast("string"), F.lit("x")),
        F.concat(F.lit("-"), s.cast("string"), F.lit("s")),
    )
    asked = derived.event_sinks(spark, folder).select("id", F.get(texts, (s % 7).cast("int")).alias("text"))
    rows = []
    for row in asked.toLocalIterator():
        try:
            rows.append((row["id"], round(names.duration_seconds(row["text"]) * 1000)))
        except ValueError:
            rows.append((row["id"], None))
    return spark.createDataFrame(rows, "id bigint, milliseconds bigint")


PAYMENT_COLUMNS = [
    {"name": "appid", "path": "appid", "type": "string", "nullable": True},
    {"name": "amount", "path": "xcontext.currencyamount", "type": "number", "nullable": True},
    {"name": "level", "path": "xcontext.level", "type": "integer", "nullable": True},
    {"name": "paid", "path": "xcontext.paymentstatus", "type": "boolean", "nullable": True},
    {"name": "sent_at", "path": "xwhen", "type": "integer"},
    {"name": "nothing", "path": "xcontext..level", "type": "json", "nullable": True},
]


def _payment_columns():
    return [projection.ColumnSpec.parse(column) for column in PAYMENT_COLUMNS]


def parquet_projection(spark, folder):
    events = replay.deliveries(planned_default(spark, folder)).select("lsn", "event_json")
    return projection.project_columns(events, _payment_columns())


def projection_violations(spark, folder):
    events = replay.deliveries(planned_default(spark, folder)).select("lsn", "event_json")
    strict = [
        projection.ColumnSpec("who", "xwho", "string"),
        projection.ColumnSpec("openid", "xcontext.openid", "integer", True),
        projection.ColumnSpec("amount", "xcontext.currencyamount", "integer", True),
    ]
    return projection.project_columns(events, strict, False).select("lsn", "violation")


def parquet_sink(spark, folder):
    """Deliveries written by the Parquet sink and read back."""
    sink = sink_spec(
        "events", "parquet",
        {"scheme": "fs", "options": {"root": scratch_path(spark, "parquet-sink")}},
        {"path_prefix": "out", "columns": PAYMENT_COLUMNS, "include_event_json": False},
    )
    delivered = replay.deliveries(planned_default(spark, folder)).filter(
        F.col("sink_id") == "events"
    )
    write_parquet(delivered, sink, "0")
    write_parquet(delivered, sink, "0")
    root = sink.target["options"]["root"] + "/out/events"
    return spark.read.parquet(root).drop("batch")


def batched_parquet(spark, folder):
    """Batches of at most 300 events, in windows of 1000 LSNs, read back by their names."""
    sink = sink_spec(
        "events", "parquet",
        {"scheme": "fs", "options": {"root": scratch_path(spark, "parquet-sink")}},
        {"path_prefix": "out", "columns": PAYMENT_COLUMNS, "batch": {"max_events": 300}},
    )
    delivered = replay.deliveries(planned_default(spark, folder)).filter(F.col("sink_id") == "events")
    write_parquet(delivered, sink, "0")
    stored = spark.read.parquet(sink.target["options"]["root"] + "/out/events")
    return stored.groupBy("batch_name").agg(
        F.count("*").alias("events"), F.sum("sent_at").alias("sent_at_sum")
    )


def kafka_messages(spark, folder):
    sink = sink_spec("events", "kafka", {"bootstrap_servers": "none:0"}, {"topic": "t"})
    delivered = replay.deliveries(planned_default(spark, folder))
    return kafka_frame(delivered, sink).select("topic", F.col("value").cast("string").alias("value"))


def console_lines(spark, folder):
    return stdout_lines(replay.deliveries(planned_default(spark, folder)))


def sink_batches(spark, folder):
    delivered = replay.deliveries(planned_default(spark, folder))
    policies = spark.createDataFrame(
        [("events", 50, 8000), ("events_error", None, 4000)],
        "sink_id string, max_events bigint, max_bytes bigint",
    )
    return batching.plan_batches(delivered, policies, max_events=20, max_records=500).select(
        "sink_id", "window_id", "chunk", "first_lsn", "last_lsn", "events", "bytes", "batch_name"
    )


def batch_members(spark, folder):
    delivered = replay.deliveries(planned_default(spark, folder))
    batches = batching.plan_batches(delivered, max_events=20, max_records=500)
    return batching.assign_batches(delivered, batches, max_records=500).select(
        "lsn", "sink_id", "batch_name"
    )


def replay_windows(spark, folder):
    records = derived.record_log(spark, folder)
    return records.groupBy(batching.window_id(F.col("lsn"), 0, 500).alias("window_id")).agg(
        F.count("*").alias("records"), F.min("lsn").alias("first_lsn"),
        F.max("lsn").alias("last_lsn"),
    )


# Metrics and streams -----------------------------------------------------------


def _observations(spark, folder):
    return admit.admission_results(checked_requests(spark, folder))


def events_total(spark, folder):
    return metrics.events_total(_observations(spark, folder))


def duration_histogram(spark, folder):
    """Latency of each event taken from its value, in seconds."""
    rows = derived.events(spark, folder).select(
        (F.col("user_id") % 5).alias("project_id"), "xwhat", F.lit("ok").alias("result"),
        (F.col("k") / 8).alias("seconds"),
    )
    return metrics.duration_histogram(rows)


def log_gauges(spark, folder):
    bounds = log.log_bounds(many_node_log(spark, folder))
    return metrics.log_gauges(bounds, log_checkpoints(bounds))


def error_totals(spark, folder):
    return metrics.error_totals(
        admit.rejections(checked_requests(spark, folder)),
        replay.quarantine(planned_default(spark, folder)),
    )


def delivery_totals(spark, folder):
    return metrics.delivery_totals(replay.deliveries(planned_default(spark, folder)))


NOW_MS = 1_706_600_000_000


def node_status(spark, folder):
    return metrics.node_status(derived.heartbeats(spark, folder), NOW_MS, refresh_seconds=3600)


def event_rates(spark, folder):
    rows = derived.events(spark, folder).select(
        (F.col("user_id") % 5).alias("project_id"), "xwhat", F.lit("ok").alias("result"),
        F.col("ms").alias("received_at_ms"),
    )
    return metrics.rates(rows, "1 hour")


def scalar_functions(spark, folder):
    """Byte lengths, base64 and text tests over whole documents."""
    docs = derived.table(spark, folder, "documents")
    body = F.to_json(F.struct("doc_id", "text"))
    return docs.select(
        "doc_id",
        jsonx.base64_line(F.col("text").cast("binary")).alias("text_base64"),
        F.octet_length("text").alias("text_bytes"),
        F.octet_length(body).alias("json_bytes"),
        jsonx.ascii_lower(F.col("text")).alias("ascii_lower"),
        F.lower("lang").alias("lower"),
        F.upper("source").alias("upper"),
        F.col("source").startswith("src1").alias("starts"),
        F.col("text").contains("the").alias("contains_the"),
    )


class StreamSite:
    """A log with Parquet sinks that is replayed as a stream, and what came out."""

    def __init__(self, spark, folder, label, reset="earliest"):
        self.spark, self.folder, self.root = spark, folder, scratch_path(spark, label)
        columns = [{"name": "sent_at", "path": "xwhen", "type": "integer"}]
        self.sinks = {
            name: sink_spec(
                name, "parquet", {"scheme": "fs", "options": {"root": self.root}},
                {"path_prefix": "out", "columns": columns}, reset,
            )
            for name in SINKS
        }

    def append(self, records, batch):
        log.store_batch(records, f"{self.root}/log", batch)

    def replay(self, **limits):
        """Catch up; the gap that stopped the query, if one did."""

        def load() -> ReplayConfig:
            scripts = default_scripts(self.spark, self.folder)
            return ReplayConfig(scripts, {"default": default_processor()}, self.sinks)

        query = replay_stream(
            self.spark, f"{self.root}/log", f"{self.root}/checkpoint", load,
            f"{self.root}/quarantine", f"{self.root}/progress", **limits,
        )
        try:
            query.awaitTermination()
        except StreamingQueryException as stopped:
            if replay.LSN_GAP_CODE not in str(stopped):
                raise
            return True
        return False

    def delivered(self, name):
        schema = "sent_at bigint, event_json string, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/out/{name}")

    def written(self):
        """Events that each sink has by now, and the waiting ones that it has not."""
        rows = []
        for name in ("events", "events_error"):
            path = f"{self.root}/out/{name}"
            there = log.exists(self.spark, path)
            rows.append((name, self.delivered(name).count() if there else 0))
        return self.spark.createDataFrame(rows, "sink_id string, records bigint")

    def totals(self):
        counts = [
            self.delivered(name).agg(
                F.lit(name).alias("sink_id"), F.count("*").alias("records"),
                F.sum("sent_at").alias("sent_at_sum"),
            )
            for name in ("events", "events_error")
        ]
        held = self.spark.read.parquet(f"{self.root}/quarantine").agg(
            F.lit("quarantine").alias("sink_id"), F.count("*").alias("records"),
            F.lit(None).cast("bigint").alias("sent_at_sum"),
        )
        return counts[0].unionByName(counts[1]).unionByName(held)


def stream_replay(spark, folder):
    """The log replayed as a stream into a Parquet sink, read back."""
    site = StreamSite(spark, folder, "stream")
    site.append(derived.record_log(spark, folder), 0)
    site.replay()
    return site.totals()


def latest_reset(spark, folder):
    """Replay that starts at the tail: the first two thirds of the log are skipped."""
    site = StreamSite(spark, folder, "stream", reset="latest")
    records = derived.record_log(spark, folder)
    cut = records.count() * 2 // 3
    site.append(records.where(F.col("lsn") <= cut), 0)
    site.replay()
    site.append(records.where(F.col("lsn") > cut), 1)
    site.replay()
    return site.totals()


def gap_stop(spark, folder):
    """A lost record stops replay, whatever the size of its batches; all before it is delivered."""
    site = StreamSite(spark, folder, "stream")
    records = derived.record_log(spark, folder)
    lost = records.count() // 2
    site.append(records.where(F.col("lsn") <= lost // 2), 0)
    site.append(records.where((F.col("lsn") > lost // 2) & (F.col("lsn") != lost)), 1)
    stopped = site.replay(batches_per_trigger=1)
    return site.totals().withColumn("stopped", F.lit(stopped))


def bounded_batches(spark, folder):
    """Replay in four windows of equally many records: what each brought."""
    site = StreamSite(spark, folder, "stream")
    records = derived.record_log(spark, folder)
    site.append(records, 0)
    site.replay(max_records=-(-records.count() // 4))
    per = [
        site.delivered(name).groupBy("batch").agg(
            F.lit(name).alias("sink_id"), F.count("*").alias("records"), F.min("sent_at").alias("first_sent_at"),
        )
        for name in ("events", "events_error")
    ]
    return per[0].unionByName(per[1]).drop("batch")


def batch_wait(spark, folder):
    """What has been written after each round of a stream whose sinks wait for full batches.

    The first fifth of the log fills no batch and waits, also half a minute on. The next two
    fifths fill one sink's batch, and all sinks are written; the rest waits for its time. A window
    that a limit cuts does not wait, so windows may be as large as what is to wait.
    """
    site = StreamSite(spark, folder, "stream")
    records = derived.record_log(spark, folder)
    total = records.count()
    per_sink = replay.deliveries(planned_default(spark, folder)).groupBy("sink_id").count()
    half = per_sink.agg(F.max("count")).first()[0] // 2
    limits = BatchLimits(max_events=half, max_bytes=1 << 40, timeout="1m")
    site.sinks = {name: replace(spec, batch=limits) for name, spec in site.sinks.items()}
    small = SmallBatches(clock=lambda: now)
    reached, out = 0, None
    for step, (now, end) in enumerate(
        [(0, total // 5), (30, total // 5 + 1), (40, 3 * total // 5), (50, total - 1), (110, total)]
    ):
        site.append(records.where((F.col("lsn") > reached) & (F.col("lsn") <= end)), step)
        site.replay(small=small, max_records=max(total, 1), max_bytes=limits.max_bytes)
        written = site.written().withColumn("step", F.lit(step))
        out, reached = written if out is None else out.unionByName(written), end
    return out


def retries(spark, folder):
    """A sink fails, later ones wait, and nothing is marked as done; once mended, all comes out once.

    ``events`` comes before the sink that fails, so it is written by the first attempt.
    """
    site = StreamSite(spark, folder, "stream")
    site.append(derived.record_log(spark, folder), 0)
    good = site.sinks
    site.sinks = {**good, "events_error": sink_spec("events_error", "blackhole", {}, {"mode": "fail"})}
    try:
        site.replay()
        raise AssertionError("the sink did not fail")
    except StreamingQueryException as stopped:
        if replay.SINK_FAILED_CODE not in str(stopped):
            raise
    first = Progress.read(spark, f"{site.root}/progress").lsns
    written = site.delivered("events").count()
    site.sinks = good
    site.replay()
    site.replay()
    reached = Progress.read(spark, f"{site.root}/progress").lsns
    # One row per step, of one node's log.
    steps = [("first events", written), ("first reached", sum(first.values())), ("reached", sum(reached.values()))]
    extra = spark.createDataFrame([(*s, None) for s in steps], "sink_id string, records bigint, sent_at_sum bigint")
    return site.totals().unionByName(extra)


def _in_thirds(spark, rows, label, start):
    """Rows that arrive in three parts by time, and a stream that is stopped and started after each."""
    root = scratch_path(spark, label)
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    cuts = [low + (high - low) * n // 3 for n in (1, 2)] if low is not None else [0, 0]
    part = F.when(F.col("ms") <= cuts[0], 0).when(F.col("ms") <= cuts[1], 1).otherwise(2)
    for n in range(3):
        rows.where(part == n).drop("ms").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.drop("ms").schema).parquet(f"{root}/in")
        start(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


def running_totals(spark, folder):
    """Counters and histograms of a stream that was started three times."""
    rows = derived.events(spark, folder).select(
        (F.col("user_id") % 5).alias("project_id"), "xwhat", F.lit("ok").alias("result"),
        (F.col("k") / 8).alias("seconds"), "ms",
    )
    return stream_metrics.running_totals(spark, _in_thirds(spark, rows, "totals", stream_metrics.totals_stream))


def node_stale(spark, folder):
    """Nodes that fell silent while others went on, by the timers of a stream."""
    rows = derived.heartbeats(spark, folder).withColumn("ms", F.col("last_seen_at"))

    def start(stream, path, checkpoint):
        return stream_metrics.node_stream(stream, path, checkpoint, 3600, by_event_time=True)

    return stream_metrics.node_states(spark, _in_thirds(spark, rows, "nodes", start))


QUERIES: dict[str, Query] = {
    "s_decode_requests": decoded_requests,
    "s_decode_spelling": decoded_spellings,
    "s_query_strings": page_queries,
    "s_log_scan": log_scan,
    "s_log_after_checkpoint": log_after_checkpoint,
    "s_log_bounds": log_bounds,
    "s_start_positions": start_positions,
    "s_enabled_config": enabled_config,
    "a_issue_counts": issue_counts,
    "a_rejections": rejected_requests,
    "a_admitted_log": admitted_log,
    "a_size_cap": size_cap,
    "v_default_rules": default_rules,
    "v_default_rule_counts": default_rule_counts,
    "v_rule_book": rule_book,
    "v_error_codes": error_codes,
    "v_value_types": value_types,
    "v_required_fields": required_fields,
    "v_predicates": predicates,
    "v_field_values": field_values,
    "v_number_limits": number_limits,
    "v_text_rules": text_rules,
    "v_temporal_rules": temporal_rules,
    "v_regex_dialect": regex_dialect,
    "v_regex_long": long_regexes,
    "v_json_equality": json_equality,
    "q_non_objects": non_objects,
    "p_loadtest_codes": loadtest_codes,
    "p_enriched_events": enriched_events,
    "p_request_values": request_values,
    "p_created_containers": created_containers,
    "v_date_formats": date_formats,
    "k_batched_parquet": batched_parquet,
    "p_parquet_projection": parquet_projection,
    "p_projection_violations": projection_violations,
    "p_sink_constants": sink_constants,
    "p_project_keys": project_keys,
    "j_request_projects": request_projects,
    "j_known_projects": known_projects,
    "j_project_scripts": project_scripts,
    "j_runtime_sinks": runtime_sinks,
    "j_delivery_sinks": delivery_sinks,
    "j_default_bindings": default_bindings,
    "j_dangling_sinks": dangling_sinks,
    "q_replay_targets": replay_targets,
    "q_quarantine_codes": quarantine_codes,
    "q_quarantine_records": quarantine_records,
    "x_project_processors": project_processors,
    "x_emit_snapshots": emit_snapshots,
    "x_python_processor": python_processor,
    "x_target_lint": target_lint,
    "w_lsn_gaps": lsn_gaps,
    "w_before_gap": before_gap,
    "w_replay_windows": replay_windows,
    "w_sink_batches": sink_batches,
    "w_batch_members": batch_members,
    "k_parquet_sink": parquet_sink,
    "k_kafka_messages": kafka_messages,
    "k_console_lines": console_lines,
    "k_sink_refusals": sink_refusals,
    "f_durations": durations,
    "m_events_total": events_total,
    "m_duration_histogram": duration_histogram,
    "m_log_gauges": log_gauges,
    "m_error_totals": error_totals,
    "m_delivery_totals": delivery_totals,
    "m_node_status": node_status,
    "f_scalar_functions": scalar_functions,
    "f_plain_ids": plain_ids,
    "t_event_rates": event_rates,
    "t_stream_replay": stream_replay,
    "t_latest_reset": latest_reset,
    "t_gap_stop": gap_stop,
    "t_bounded_batches": bounded_batches,
    "t_batch_wait": batch_wait,
    "t_retries": retries,
    "t_running_totals": running_totals,
    "t_node_stale": node_stale,
}
