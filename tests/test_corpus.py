"""Validation cases: an event and the exact first error the rules report."""

import copy

import pytest

from eventrail.functions.extract import with_error
from eventrail.plans.standard import CURRENCIES, default_checks, standard_rule_book
from tests.frames import events

IOS = {"os": "iOS", "installid": "iid", "idfa": "a", "caid": "c", "androidid": "", "model": "m"}
HARMONY = {"os": "harmony", "installid": "iid", "oaid": "o", "androidid": "d"}
WECHAT = {"os": "wechat", "installid": "iid", "openid": "op", "querystring": {"k": "v"}, "scene": 1}
PAID = {"transactionid": "t", "paymenttype": "card", "currencytype": "CNY", "currencyamount": 0.99}


def event(name="custom", context=IOS, without=(), **changes):
    made = {
        "appid": "APP", "xwhat": name, "xwho": "someone", "xwhen": 1718255925637,
        "xcontext": copy.deepcopy(context), **changes,
    }
    for path in without:
        *above, last = path.split(".")
        node = made
        for part in above:
            node = node[part]
        node.pop(last)
    return made


def paid(without=(), context=IOS, **changes):
    return event("payment", {**context, **PAID, **changes}, [f"xcontext.{n}" for n in without])


def missing(path):
    return f"missing required field `{path}`"


def one_of(*names):
    return "at least one field is required: " + ", ".join(f"xcontext.{n}" for n in names)


CASES = {
    "no appid": (event(without=["appid"]), missing("appid")),
    "no xwhat": (event(without=["xwhat"]), missing("xwhat")),
    "no xwhen": (event(without=["xwhen"]), None),
    "custom": (event(), None),
    "with ip": (event(context={**IOS, "ip": "8.8.8.8"}), None),
    "harmony": (event(context=HARMONY), None),
    "ios without ids": (event(without=["xcontext.idfa", "xcontext.caid"]), one_of("idfa", "caid")),
    "android without ids": (
        event(context={"os": "android", "installid": "i"}), one_of("oaid", "androidid"),
    ),
    "wechat without ids": (
        event(context={"os": "wechat", "installid": "i"}), one_of("openid", "unionid"),
    ),
    "no installid": (event(context=HARMONY, without=["xcontext.installid"]), missing("xcontext.installid")),
    "install": (event("install", {**HARMONY, "arg1": "1"}), None),
    "startup": (event("startup"), None),
    "register": (event("register"), None),
    "register without who": (event("register", without=["xwho"]), missing("xwho")),
    "wechat install": (event("install", WECHAT, xwho=None), None),
    "wechat register": (event("register", WECHAT), None),
    "wechat payment": (paid(context=WECHAT, paymentstatus=True), None),
    "payment": (paid(), None),
    "payment status": (paid(paymentstatus=True), None),
    "no transactionid": (paid(["transactionid"]), missing("xcontext.transactionid")),
    "no paymenttype": (paid(["paymenttype"]), missing("xcontext.paymenttype")),
    "no currencytype": (paid(["currencytype"]), missing("xcontext.currencytype")),
    "no currencyamount": (paid(["currencyamount"]), missing("xcontext.currencyamount")),
    "unknown currency": (
        paid(currencytype="XXX"),
        f"field `xcontext.currencytype` must be one of [{', '.join(CURRENCIES)}]",
    ),
    "amount as text": (
        paid(currencyamount="123", paymentstatus=True),
        "field `xcontext.currencyamount` expected type `Number`",
    ),
    "status as text": (
        paid(paymentstatus="true"), "field `xcontext.paymentstatus` expected type `Boolean`",
    ),
    "levelup zero": (
        event("levelup", {**IOS, "level": 0}), "field `xcontext.level` must be greater than 0",
    ),
    "levelup fraction": (
        event("levelup", {**IOS, "level": 1.5}), "field `xcontext.level` expected type `Integer`",
    ),
}

# What the rule book checks and the default checks do not, and the other way round.
BOOK = {
    "no xcontext": (event(without=["xcontext"]), missing("xcontext")),
    "login": (event("login"), None),
    "login without who": (event("login", without=["xwho"]), missing("xwho")),
    "wechat login": (event("login", WECHAT), None),
    "enterserver": (event("enterserver"), None),
    "enterserver without who": (event("enterserver", without=["xwho"]), missing("xwho")),
    "lower case currency": (paid(currencytype="cny"), None),
}
DEFAULT = {
    "no xcontext": (event(without=["xcontext"]), missing("xcontext.os")),
    "empty appid": (event(appid=""), "field `appid` length must be at least 1"),
    "login without who": (event("login", without=["xwho"]), None),
    "tiktok without openid": (
        event(context={"os": "TikTok", "installid": "i"}), missing("xcontext.openid"),
    ),
}


@pytest.mark.parametrize(
    ("steps", "extra"), [(default_checks, DEFAULT), (standard_rule_book().steps, BOOK)]
)
def test_first_errors(spark, steps, extra):
    cases = {**CASES, **extra}
    frame = events(spark, *[body for body, _ in cases.values()]).repartition(2)
    found = {row["i"]: row["error"] for row in with_error(frame, steps()).collect()}
    wrong = {
        name: (found[i], expected)
        for i, (name, (_, expected)) in enumerate(cases.items())
        if found[i] != expected
    }
    assert not wrong
