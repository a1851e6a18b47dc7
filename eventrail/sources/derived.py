"""Requests, record logs and configuration derived from the sample tables.

The tables are business data; these views give them the shape of event traffic. Every
defect (missing field, bad token, cut body, ...) is a function of plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.session import configure

EVENT_NAMES = {
    "signup": "register", "purchase": "payment", "view": "startup", "click": "levelup",
}
OS_NAMES = ["iOS", "android", "harmony", "wechat", "tiktok", "symbian"]
SCRIPT_KEYS = ["default", "strict", "lost", "loadtest", "enrichment"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One sample table, as its files are split.

    The samples are files of one row group, which one task reads. A benchmark may set
    ``eventrail.sample.partitions`` to deal the rows to that many; nothing else sets it.
    """
    df = configure(spark).read.parquet(f"{folder}/{name}.parquet")
    partitions = spark.conf.get("eventrail.sample.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with names, receive time in ms and the ``k`` of its properties."""
    kind = F.col("event_type")
    name = F.lit("custom_event")
    for source, target in EVENT_NAMES.items():
        name = F.when(kind == source, target).otherwise(name)
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "value",
        "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        name.alias("xwhat"),
        F.get(F.array(*map(F.lit, OS_NAMES)), (F.col("event_id") % 6).cast("int")).alias("os"),
    )


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def event_body() -> Column:
    """Event text of one row of ``events``; keys are sorted, absent fields left out."""
    e, name, os = F.col("event_id"), F.col("xwhat"), F.col("os")
    fifth = e % 5 == 0
    context = F.struct(
        F.when(name == "payment", F.col("value")).alias("currencyamount"),
        F.when(name == "payment", F.when(e % 13 == 0, "XYZ").otherwise("USD")).alias("currencytype"),
        F.when((os == "iOS") & ~fifth, _text("idfa-", e)).alias("idfa"),
        F.when(e % 11 == 0, "").otherwise(_text("iid-", e)).alias("installid"),
        F.when(name == "levelup", F.col("k") % 3).alias("level"),
        F.when(
            os.isin("android", "harmony"), F.when(e % 4 == 0, "").otherwise(_text("oaid-", e))
        ).alias("oaid"),
        F.when(os.isin("wechat", "tiktok") & ~fifth, _text("open-", e)).alias("openid"),
        os.alias("os"),
        F.when((name == "payment") & (e % 3 == 0), F.lit(True)).alias("paymentstatus"),
        F.when(name == "payment", "card").alias("paymenttype"),
        F.when(name == "payment", _text("tx-", e)).alias("transactionid"),
    )
    whole = F.to_json(
        F.struct(
            _unless(e % 29 == 0, _text("app_", F.col("user_id") % 4)).alias("appid"),
            context.alias("xcontext"),
            name.alias("xwhat"),
            F.col("ms").alias("xwhen"),
            _unless(e % 7 == 0, _text("u", F.col("user_id"))).alias("xwho"),
        )
    )
    return F.when(e % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole)


def record_log(spark: SparkSession, folder: str) -> DataFrame:
    """One log record per event, on one node."""
    e, user = F.col("event_id"), F.col("user_id")
    return events(spark, folder).select(
        _text("wal-", F.col("ms"), "-", e).alias("record_id"),
        (e + 1).alias("lsn"),
        user.cast("int").alias("project_id"),
        F.col("ms").alias("received_at_ms"),
        F.lit("POST").alias("method"),
        _text("/ingest/p-", user).alias("path"),
        F.lit(None).cast("string").alias("query"),
        F.when(e % 10 != 9, _text("10.0.0.", e % 256)).alias("remote_addr"),
        F.create_map(F.lit("User-Agent"), _text("ua-", user % 3)).alias("headers"),
        event_body().alias("body"),
        F.lit("node-a").alias("node_id"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One HTTP request per event: JSON and form posts, GETs and other methods."""
    e, user = F.col("event_id"), F.col("user_id")
    token = _text("tok-", user)
    method = F.when(e % 20 == 0, "PUT").when(e % 20 < 4, "GET").otherwise("POST")
    is_form = e % 4 == 1
    body_token = F.when(e % 3 == 0, None).when(e % 10 == 7, "other").otherwise(token)
    json_body = F.to_json(
        F.struct(
            e.alias("n"), F.col("value").alias("v"),
            body_token.alias("x-ingest-token"), F.col("xwhat"),
        )
    )
    form_body = F.concat(
        _text("xwhat=", F.col("xwhat"), "&n=", e, "&name=a%20b+c%zz&n=", e + 1),
        F.when(body_token.isNull(), "").otherwise(F.concat(F.lit("&x-ingest-token="), body_token)),
    )
    body = (
        F.when(e % 23 == 0, "")
        .when(is_form, form_body)
        .when(e % 29 == 0, F.concat(json_body, F.lit(" x")))
        .otherwise(json_body)
    )
    query = F.concat(
        _text("xwhat=", F.col("xwhat"), "&n=", e, "&b=%E4%BD%A0"),
        F.when(e % 40 == 1, "&x-ingest-token=t").otherwise(""),
    )
    header_token = F.when(
        e % 3 != 1, F.create_map(F.lit("X-Ingest-Token"), F.concat(F.lit(" "), token))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return events(spark, folder).select(
        _text("node-", user % 3).alias("node_id"),
        e.alias("request_seq"),
        F.col("ms").alias("received_at_ms"),
        method.alias("method"),
        F.lit("/ingest").alias("path"),
        F.when(e % 31 == 0, "nope").otherwise(_text(" p-", user, " ")).alias("project_key"),
        F.when(method == "GET", query).alias("query"),
        F.map_concat(header_token, F.create_map(F.lit("User-Agent"), F.lit("ua"))).alias("headers"),
        F.when(is_form, "Application/X-WWW-Form-Urlencoded; charset=utf-8")
        .otherwise("application/json")
        .alias("content_type"),
        _text("10.0.0.", e % 4).alias("remote_addr"),
        F.when(method == "POST", body).alias("body"),
    )


def spelled_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Posts whose bodies spell tokens, numbers and keys in many ways, and bad forms."""
    e = F.col("event_id")
    token = F.array(
        F.lit('{"a":[1,"]"]}'), F.lit('["s"]'), F.lit("null"), F.lit("1.0"), F.lit("true"),
        _text('" tok-', e, ' "'), F.lit('""'),
    )
    whole = (e % 100).cast("string")
    number = F.array(
        _text(whole, ".0"), _text(whole, ".50"), _text(whole, "e3"), _text("-", whole, ".25E+1"), whole,
    )
    body = _text(
        '{ "z" : ', F.get(number, (e % 5).cast("int")), ', "x-ingest-token" :', F.get(token, (e % 7).cast("int")),
        ',"a": 1,\n"in":{"x-ingest-token":"kept 1.0","b":[2.0, 3]},"a":"last ', e, '"}',
    )
    form = e % 11 == 0
    return events(spark, folder).select(
        e.alias("request_seq"), F.lit("POST").alias("method"), F.lit(None).cast("string").alias("query"),
        F.when(form, "application/x-www-form-urlencoded").otherwise("application/json").alias("content_type"),
        # A form that is no UTF-8 text is refused.
        F.when(form & (e % 2 == 0), F.unhex(F.lit("613DFF"))).when(form, F.lit("a=1&x-ingest-token=f").cast("binary"))
        .otherwise(body.cast("binary")).alias("body"),
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        c.alias("id"),
        _text("tok-", c).alias("ingest_token"),
        _text("p-", c).alias("project_key"),
        F.when(c % 4 == 0, "public").when(c % 4 == 1, "other").otherwise("token").alias("auth_mode"),
        F.when(c % 5 == 0, '[" 10.0.0.1 ","10.0.0.3",""]').otherwise("[]").alias("allowed_ips"),
        F.col("c_name").alias("name"),
        (c % 7 != 6).alias("enabled"),
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, folder, "part").select(
        p.alias("id"),
        F.get(F.array(*map(F.lit, SCRIPT_KEYS)), (p % 5).cast("int")).alias("script_key"),
        F.when(p % 11 == 0, "draft").otherwise("active").alias("status"),
    )


def bindings(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    bound = table(spark, folder, "orders").filter(F.col("o_custkey") % 4 != 3)
    scripts_there = table(spark, folder, "part").agg(F.coalesce(F.max("p_partkey"), F.lit(0)) + 1).scalar()
    return bound.select(
        o.alias("id"),
        F.col("o_custkey").alias("project_id"),
        (o % scripts_there).alias("processor_script_id"),
        (o % 3 != 0).alias("enabled"),
    )


def delivery_targets(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        n.cast("bigint").alias("id"),
        F.col("n_name").alias("target_id"),
        F.lit("blackhole").alias("target_type"),
        F.lit("{}").alias("config_json"),
        (n % 4 != 3).alias("enabled"),
    )


def event_sinks(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        s.alias("id"),
        F.concat(
            F.lit("sink"), F.when(s % 2 == 0, "-").otherwise("_."), (s - s % 3).cast("string"),
            F.when(s % 3 == 1, "-").when(s % 3 == 2, "x").otherwise(""),
        ).alias("sink_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("bigint").alias("delivery_target_id"),
        F.lit("{}").alias("destination_json"),
        F.when(s % 50 == 49, "earliest").otherwise("latest").alias("auto_offset_reset"),
        (s % 6 != 5).alias("enabled"),
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a sign of life of its user's node."""
    e = F.col("event_id")
    return events(spark, folder).select(
        _text("node-", F.col("user_id")).alias("node_id"),
        F.when(F.col("user_id") % 5 == 0, "stopped").otherwise("running").alias("status"),
        _text("1.", e).alias("version"),
        F.col("ms").alias("last_seen_at"),
    )


def documents_as_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the text of a posted event."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.lit("node-d").alias("node_id"),
        doc.alias("request_seq"),
        doc.alias("received_at_ms"),
        F.lit("POST").alias("method"),
        F.lit("/ingest").alias("path"),
        F.lit("p-0").alias("project_key"),
        F.lit(None).cast("string").alias("query"),
        F.create_map(F.lit("accept"), F.lit("*/*")).alias("headers"),
        F.lit("application/json").alias("content_type"),
        F.lit("10.0.0.1").alias("remote_addr"),
        F.to_json(F.struct(doc.alias("doc_id"), F.col("lang"), F.col("text"))).alias("body"),
    )
