import json

import pytest

from eventrail.functions.extract import with_error
from eventrail.plans.rules import field_steps, load_rule_book
from tests.frames import events

FILES = {
    "default.json": {"fields": {"appid": {"required": True, "type": "string"}}},
    "open.json": {"fields": {"mode": {"enum": ["Fast", "slow"], "type": "string"}}},
    "user/default.json": {"fields": {"who": {"required": True, "min": 2, "type": "string"}}},
    "user/pay.json": {"fields": {"sum": {"type": "number", "gte": 1, "lt": 10}}},
    "user/login.json": {},
}


def test_files_cascade(spark, tmp_path):
    for name, rules in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(rules))
    cases = [
        ({"xwhat": "pay"}, "missing required field `appid`"),
        ({"appid": "a", "xwhat": "other"}, None),
        ({"appid": "a", "xwhat": "open", "mode": "FAST"}, None),
        ({"appid": "a", "xwhat": "open", "mode": "x"}, "field `mode` must be one of [Fast, slow]"),
        ({"appid": "a", "xwhat": "login"}, "missing required field `who`"),
        ({"appid": "a", "xwhat": "pay", "who": "x"}, "field `who` length must be at least 2"),
        ({"appid": "a", "xwhat": "pay", "who": "xy", "sum": 10}, "field `sum` must be less than 10"),
        ({"appid": "a", "xwhat": "pay", "who": "xy", "sum": 2}, None),
        ({"appid": "a", "xwhat": "pay", "who": "xy"}, None),
    ]
    frame = events(spark, *[body for body, _ in cases])
    rows = with_error(frame, load_rule_book(tmp_path).steps()).orderBy("i").collect()
    assert [row["error"] for row in rows] == [error for _, error in cases]


def test_unknown_rules_are_refused():
    for rule in ({"typo": 1}, {"type": "date"}):
        with pytest.raises(ValueError):
            field_steps("a", rule)
