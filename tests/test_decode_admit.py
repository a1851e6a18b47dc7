import json

from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.operators import admit, decode
from tests.frames import events

SCHEMA = (
    "node_id string, request_seq bigint, received_at_ms bigint, method string, path string, "
    "project_key string, query string, headers map<string,string>, content_type string, "
    "remote_addr string, body string"
)
FORM = "application/x-www-form-urlencoded; charset=utf-8"


def requests(spark, *items):
    rows = []
    for i, item in enumerate(items):
        full = {
            "method": "POST", "project_key": "app", "query": None, "headers": {},
            "content_type": "application/json", "remote_addr": "1.1.1.1", "body": "{}", **item,
        }
        rows.append((
            "n", i, i, full["method"], "/ingest", full["project_key"], full["query"],
            full["headers"], full["content_type"], full["remote_addr"], full["body"],
        ))
    return spark.createDataFrame(rows, SCHEMA)


def test_strict_parse(spark):
    good = ["1", '"x"', "null", "[1]", ' {"a":1} ', '{"a":1,"a":2}', '{"a":"\\ud83d\\ude00"}',
            '{"a":"\\\\ud800"}', '{"a":"1e999 Infinity"}', '{"a":1e300}']
    bad = ["", " ", "{", '{"a":1} x', "1,2", "1],[2", "1}{", '{"a":01}', '{"a":NaN}', "{'a':1}",
           '{"a":1e999}', '{"a":"\\ud800"}', '"\\udc00"', '{"a":1}{"b":2}', "tru"]
    rows = events(spark, *good, *bad).select("i", "event").collect()
    parsed = {row["i"]: row["event"] is not None for row in rows}
    assert [i for i, ok in parsed.items() if ok] == list(range(len(good)))


def test_nesting_limit(spark):
    bodies = ["[" * n + "]" * n for n in (127, 128, 200)]
    bodies += ['{"a":' * 127 + "1" + "}" * 127, '{"a":' * 128 + "1" + "}" * 128, '["' + "[" * 300 + '"]']
    rows = events(spark, *bodies).orderBy("i").collect()
    assert [row["event"] is not None for row in rows] == [True, False, False, True, False, True]


def test_token_never_stays_and_numbers_keep_their_kind(spark):
    cases = {
        '{"x-ingest-token":{"a":1},"v":1.0}': '{"v":1.0}',
        '{"x-ingest-token":["s", {"x":"]"}],"v":2e3}': '{"v":2000.0}',
        '{"x-ingest-token":null,"b":1.0,"a":2,"a":3}': '{"a":3,"b":1.0}',
        '{"x-ingest-token":"a","x-ingest-token":"b","s":"1.50 e \\" 1.0","v":1.50}': '{"s":"1.50 e \\" 1.0","v":1.5}',
        '{"v":[1e16,1E15,1.5e-7,0.00001,0.000123,12345678.9,-0,-0.0,0.0,1e-6,123456789012345680000]}':
            '{"v":[1e16,1000000000000000.0,1.5e-7,0.00001,0.000123,12345678.9,-0.0,-0.0,0.0,1e-6,1.2345678901234568e20]}',
        '{"v":[18446744073709551615,-9223372036854775808,18446744073709551616]}':
            '{"v":[18446744073709551615,-9223372036854775808,1.8446744073709552e19]}',
        '[1.0, {"x-ingest-token":1.0}]': '[1.0,{"x-ingest-token":1.0}]',
        "1.0": "1.0",
    }
    rows = decode.decode(requests(spark, *[{"body": b} for b in cases])).orderBy("request_seq").collect()
    found = [row["event_text"] for row in rows]
    assert found == list(cases.values())


def test_decoded_text(spark):
    items = [
        {"body": '{"b": 1, "x-ingest-token": " t ", "a": [1, 2]}'},
        {"body": '{"a":68.0,\n "x-ingest-token" : "t", "s":"x y"}'},
        {"body": '{"x-ingest-token":5,"a":1e2}'},
        {"body": '{"in":{"x-ingest-token":"t"},"a":1.50}'},
        {"body": "[1, 2]"},
        {"body": "b=2&a=x+y%21&b=3&x-ingest-token=t&x-ingest-token=+&c&=v&e=%zz", "content_type": FORM.upper()},
        {"body": "a=1&x-ingest-token=one&x-ingest-token=two", "content_type": FORM},
        {"method": "GET", "query": "b=2&a=%E4%BD%A0&b=4"},
        {"method": "GET", "query": None},
    ]
    rows = decode.decode(requests(spark, *items)).orderBy("request_seq").collect()
    assert [(row["event_text"], row["body_token"]) for row in rows] == [
        ('{"a":[1,2],"b":1}', "t"),
        ('{"a":68.0,"s":"x y"}', "t"),
        ('{"a":100.0}', None),
        ('{"a":1.5,"in":{"x-ingest-token":"t"}}', None),
        ("[1,2]", None),
        ('{"":"v","a":"x y!","b":"3","c":"","e":"%zz"}', None),
        ('{"a":"1"}', "two"),
        ('{"a":"你","b":"4"}', None),
        ("{}", None),
    ]


def test_issues_in_order(spark):
    projects = spark.createDataFrame(
        [
            (1, "secret", "app", "token", "[]", True),
            (2, "s2", "open", "public", "[]", True),
            (3, "s3", "fenced", "public", '[" 9.9.9.9 ", ""]', True),
            (4, "s4", "off", "public", "[]", False),
            (5, "s5", "odd", "whatever", "not json", True),
        ],
        "id int, ingest_token string, project_key string, auth_mode string, allowed_ips string, enabled boolean",
    )
    token = {"X-Ingest-Token": " secret "}
    items = [
        ({"method": "PUT", "project_key": "none"}, "ingest_method_not_allowed"),
        ({"body": "", "project_key": "none"}, "ingest_missing_request_body"),
        ({"body": "{", "project_key": "none"}, "ingest_invalid_json"),
        ({"method": "GET", "query": "x-ingest-token="}, "ingest_query_token_not_supported"),
        ({"project_key": "none"}, "ingest_project_not_found"),
        ({"project_key": "off"}, "ingest_project_not_found"),
        ({"project_key": "fenced"}, "ingest_ip_not_allowed"),
        ({"project_key": "fenced", "remote_addr": "9.9.9.9"}, None),
        ({"headers": token, "body": '{"x-ingest-token":"other"}'}, "ingest_conflicting_token"),
        ({}, "ingest_missing_token"),
        ({"headers": {"x-ingest-token": "  "}}, "ingest_missing_token"),
        ({"headers": {"x-ingest-token": "wrong"}}, "ingest_invalid_token"),
        ({"headers": token, "project_key": " app "}, None),
        ({"body": '{"x-ingest-token":"secret","xwhat":"go"}'}, None),
        ({"project_key": "open", "headers": {"a": "b"}, "body": '{"x-ingest-token":"x"}'}, None),
        ({"project_key": "odd"}, "ingest_missing_token"),
        ({"project_key": "open", "body": json.dumps({"a": "é" * 50})}, "ingest_payload_too_large"),
        ({"project_key": "open", "body": '{"a" :   "' + " " * 40 + '"}'}, None),
    ]
    checked = admit.admit(requests(spark, *[item for item, _ in items]), projects, 100)
    rows = checked.orderBy("request_seq").collect()
    assert [row["issue_code"] for row in rows] == [code for _, code in items]
    assert rows[13]["event_name"] == "go" and rows[12]["event_name"] == "default"
    assert rows[12]["headers"] == {} and rows[14]["headers"] == {"a": "b"}
    refused = {row["issue_code"]: row["status"] for row in admit.rejections(checked).collect()}
    assert refused["ingest_payload_too_large"] == 413 and refused["ingest_ip_not_allowed"] == 403
    assert admit.admitted(checked).count() == sum(code is None for _, code in items)


def test_base64_has_no_line_breaks(spark):
    row = spark.range(1).select(jsonx.base64_line(F.expr("cast(repeat('abc', 200) as binary)")).alias("b")).first()
    assert len(row["b"]) == 800
