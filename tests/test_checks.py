import pytest
from pyspark.sql import functions as F

from eventrail.functions.checks import Event, classify_error, number_text, when
from eventrail.functions.extract import with_conditions
from eventrail.functions.regexes import to_java
from eventrail.functions.temporal import compile_format
from tests.frames import errors, events

BODY = {
    "s": "abc", "n": 5, "b": True, "o": {"x": None}, "l": [1], "z": None, "e": "", "neg": -3,
    "d": "2024-02-29", "t": "23:59:60", "dt": "2024-01-02 03:04:05.000000001", "u": "你好",
    "k": "\u212a", "": {"": 1}, "os": "iOS",
}


def test_presence_and_types(spark):
    assert errors(
        spark, BODY,
        Event.required("z"), Event.required("e"), Event.optional("z").string(),
        Event.field("n").string(), Event.required("n").integer(), Event.required("b").boolean(),
        Event.required("o").object(), Event.required("l").array(), Event.required("o").array(),
        Event.required("l.0"), Event.required("o.x"), Event.required(".").integer(),
    ) == [
        "missing required field `z`", None, None,
        "field `n` expected type `String`", None, None,
        None, None, "field `o` expected type `Array`",
        "missing required field `l.0`", "missing required field `o.x`", None,
    ]


def test_integers_keep_their_kind(spark):
    body = '{"i":1,"f":1.0,"big":18446744073709551615,"huge":18446744073709551616,"x":1e2}'
    number = "field `{}` expected type `Integer`".format
    assert errors(
        spark, body, *[Event.required(n).integer() for n in ("i", "f", "big", "huge", "x")],
        *[Event.required(n).number() for n in ("i", "f", "big", "huge", "x")],
    ) == [None, number("f"), None, number("huge"), number("x"), *[None] * 5]


def test_text_checks(spark):
    assert errors(
        spark, BODY,
        Event.required("s").string().min(4), Event.required("u").string().min(2),
        Event.field("n").min(9), Event.required("s").string().enum(["ABC", "d"]),
        Event.required("s").string().ignore_case().enum(["ABC"]),
        Event.required("s").one_of(["ABC"]), Event.required("n").one_of(["5"]),
        Event.required("k").one_of(["k"]),
        Event.required("s").string().matches("^b"), Event.required("u").string().matches(r"^\w+$"),
        Event.required("s").string().ignore_case().matches("^AB"),
    ) == [
        "field `s` length must be at least 4", None, None,
        "field `s` must be one of [ABC, d]", None, None, "field `n` expected type `String`",
        "field `k` must be one of [k]", "field `s` must match regex `^b`", None, None,
    ]


def test_temporal_checks(spark):
    assert errors(
        spark, BODY,
        Event.required("d").string().date("%Y-%m-%d"), Event.required("d").string().date("%Y/%m/%d"),
        Event.required("t").string().time("%H:%M:%S"),
        Event.required("dt").string().datetime("%Y-%m-%d %H:%M:%S.%f"),
        Event.required("d").string().date("%m"), Event.optional("gone").string().date("%F"),
    ) == [
        None, "field `d` must be a valid date matching format `%Y/%m/%d`", None, None,
        "field `d` must be a valid date matching format `%m`", None,
    ]


def test_number_checks(spark):
    n = Event.required("n")
    assert errors(
        spark, BODY, n.gt(5), n.gte(5), n.lt(4.5), n.lte(5), Event.field("s").gt(1),
        Event.field("neg").lt(-3), Event.field("gone").gt(1),
    ) == [
        "field `n` must be greater than 5", None, "field `n` must be less than 4.5", None,
        "field `s` could not be represented as f64", "field `neg` must be less than -3", None,
    ]
    assert number_text(0.0) == "0" and number_text(1e-7) == "0.0000001"


def test_any_and_conditional(spark):
    ios = Event.required("os").ignore_case().eq("ios")
    assert errors(
        spark, BODY,
        Event.any(["e", "z"]).required(), Event.any(["e", "s"]).required(),
        when(ios, Event.required("gone")), when(~ios, Event.required("gone")),
        when(Event.field("os").eq("ios"), otherwise=[Event.required("z")]),
    ) == [
        "at least one field is required: e, z", None, "missing required field `gone`", None,
        "missing required field `z`",
    ]


def test_conditions(spark):
    field = Event.field
    row = with_conditions(
        events(spark, '{"s":"ABC","n":1,"f":1.0,"l":[1,2],"z":null,"e":"","b":false,"o":{"a":1}}'),
        {
            "text": field("s").eq("abc"), "folded": field("s").ignore_case().eq("abc"),
            "int": field("n").eq(1), "int_float": field("n").eq(1.0), "float": field("f").eq(1.0),
            "float_int": field("f").eq(1), "list": field("l").eq([1, 2]), "null": field("z").eq(None),
            "gone": field("g").eq(None), "bool": field("b").eq(False), "object": field("o").eq({"a": 1}),
            "object_float": field("o").eq({"a": 1.5}),
            "empty": field("e").exists(), "missing": field("e").missing(), "key": Event.contains("z"),
        },
    ).drop("i", "body", "event").first().asDict()
    true = {"folded", "int", "float", "list", "null", "bool", "object", "missing", "key"}
    assert {name for name, value in row.items() if value} == true
    assert None not in row.values()


@pytest.mark.parametrize(
    "build",
    [
        lambda: Event.field("a").enum(["x"]),
        lambda: Event.field("a").string().enum([]),
        lambda: Event.field("a").string().enum([1]),
        lambda: Event.field("a").string().number().matches("x"),
        lambda: Event.field("a").date("%F"),
        lambda: Event.field("a").string().date("%A"),
        lambda: Event.field("a").string().matches("(?=x)"),
        lambda: Event.field("a").string().matches(r"(a)\1"),
        lambda: Event.field("a").string().matches("a++"),
    ],
)
def test_misuse_is_a_build_error(build):
    with pytest.raises(ValueError):
        build()


def test_regex_dialect():
    assert to_java("a$") == r"(?Ud)a\z"
    assert to_java(r"(?P<x>\+)+[$]", True) == r"(?Udi)(?<x>\+)+[$]"
    assert compile_format("date", "%d.%m.%Y").pattern == "dd.MM.yyyy"


def test_error_classes(spark):
    texts = [
        ("missing required field `a`", "rules_required_field_missing"),
        ("at least one field is required: a", "rules_conditional_required_missing"),
        ("field `a` expected type `Number`", "rules_field_type_mismatch"),
        ("field `a` must be one of [x]", "rules_enum_value_invalid"),
        ("field `a` could not be represented as f64", "rules_number_parse_failed"),
        ("field `a` must be less than or equal to 3", "rules_number_constraint_failed"),
        ("something else", "rules_script_execution_failed"),
        (None, None),
    ]
    rows = spark.createDataFrame(texts, "text string, code string")
    assert rows.filter(~F.equal_null(classify_error(F.col("text")), F.col("code"))).count() == 0
