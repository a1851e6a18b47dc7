"""The standard rule sets and processors."""

from __future__ import annotations

from eventrail import __version__
from eventrail.functions.checks import Event, Step, when
from eventrail.plans.processor import (
    Emit,
    ErrorCode,
    ErrorText,
    Literal,
    ObjectValue,
    Processor,
    Request,
    Set,
    attempt,
    processor,
)
from eventrail.plans.rules import RuleBook

# What the standard rules accept.
PLATFORMS = ["ios", "android", "harmony", "wechat", "toutiao", "tiktok"]
CURRENCIES = [
    "JPY", "EUR", "BRL", "HKD", "TWD", "COP", "MXN", "CHF", "CAD", "CLP", "AUD", "PEN", "GBP",
    "CRC", "PLN", "PYG", "BOB", "QAR", "ILS", "SEK", "RUB", "CNY", "USD", "ZAR", "SGD", "NZD",
    "BGN", "LKR", "IQD", "TRY", "AED", "DZD", "EGP", "IDR", "INR", "NGN", "NOK", "PHP", "PKR",
    "THB", "UAH", "VND",
]
# Platform -> device ids of which one is needed.
DEVICE_IDS = {
    ("ios",): ("idfa", "caid"),
    ("android", "harmony"): ("oaid", "androidid"),
    ("wechat",): ("openid", "unionid"),
}
OPEN_ID_PLATFORMS = ("toutiao", "tiktok")


def _context(name: str) -> str:
    return f"xcontext.{name}"


def _text(path: str):
    return Event.required(path).string().min(1)


def _any_of(field, values):
    condition = field.eq(values[0])
    for value in values[1:]:
        condition = condition | field.eq(value)
    return condition


def default_checks() -> list[Step]:
    """Base fields, device ids per platform, then what each event name demands."""
    name = _text("xwhat")
    platform = Event.required(_context("os")).string().ignore_case()
    steps: list[Step] = [
        name,
        platform.enum(PLATFORMS),
        _text("appid"),
        Event.required("xcontext").object(),
        _text(_context("installid")),
    ]
    for platforms, ids in DEVICE_IDS.items():
        needed = Event.any([_context(i) for i in ids]).required()
        steps.append(when(_any_of(platform, platforms), needed))
    steps.append(when(_any_of(platform, OPEN_ID_PLATFORMS), _text(_context("openid"))))

    who = _text("xwho")
    payment = [
        who,
        _text(_context("transactionid")),
        _text(_context("paymenttype")),
        Event.required(_context("currencytype")).string().enum(CURRENCIES),
        Event.required(_context("currencyamount")).number(),
        Event.optional(_context("paymentstatus")).boolean(),
    ]
    level = Event.required(_context("level")).integer().gt(0)
    steps.append(when(name.eq("register"), who))
    steps.append(when(name.eq("payment"), *payment))
    steps.append(when(name.eq("levelup"), who, level))
    return steps


def default_processor(good: str = "events", bad: str = "events_error") -> Processor:
    """Valid events to one sink, the others to another."""
    return processor(
        "default", attempt(*default_checks(), Emit(good), catch=[Emit(bad)])
    )


def loadtest_processor(target: str = "loadtest_events") -> Processor:
    """Everything to one sink, invalid events marked with the code of their error."""
    # Setting a nested field creates a missing context.
    mark = Set(_context("loadtest_validation_code"), ErrorCode())
    return processor(
        "loadtest",
        attempt(*default_checks(), catch=[mark]),
        Emit(target),
    )


def enrichment_processor(good: str = "events", bad: str = "events_error") -> Processor:
    """Fill in defaults, normalise spelling and attach processing info."""
    context = {n: Event.field(_context(n)) for n in ("os", "platform", "currencytype", "ip")}
    info = {
        "receive_time": Request.received_at_ms(),
        "version": Literal(__version__),
    }
    failure = {**info, "reason": ErrorText(), "error_code": ErrorText()}
    present = {n: ~f.eq(None) & _has(n) for n, f in context.items()}
    return processor(
        "enrichment",
        attempt(
            _text("appid"),
            _text("xwhat"),
            Event.required("xcontext").object(),
            _text(_context("installid")),
            _text(_context("os")),
            when(
                ~Event.contains("xwhen") | Event.field("xwhen").eq(None),
                Set("xwhen", Request.received_at_ms()),
            ),
            Set(_context("os"), context["os"].value().lower()),
            when(~present["platform"], Set(_context("platform"), context["os"].value())),
            when(
                present["currencytype"],
                Set(_context("currencytype"), context["currencytype"].value().upper()),
            ),
            when(~present["ip"] & Request.has_ip(), Set(_context("ip"), Request.ip())),
            Set(_context("process_info"), ObjectValue(info)),
            Emit(good),
            catch=[
                Set(_context("process_info"), ObjectValue(failure)),
                Emit(bad),
            ],
        ),
    )


def _has(name: str):
    return Event.contains(_context(name))


def standard_rule_book() -> RuleBook:
    """The rules as data: a default and, for user events, who acted plus the details."""
    def text(**more):
        return {"required": True, "type": "string", **more}

    os_rule = text(
        enum=PLATFORMS,
        required_any_when=[
            {"equals": platform, "fields": [_context(i) for i in ids]}
            for platforms, ids in DEVICE_IDS.items()
            for platform in platforms
        ],
        required_when=[
            {"equals": platform, "fields": [_context("openid")]} for platform in OPEN_ID_PLATFORMS
        ],
    )
    default = {
        "appid": text(),
        "xwhat": text(),
        "xcontext": {"required": True, "type": "object"},
        _context("installid"): text(),
        _context("os"): os_rule,
    }
    payment = {
        _context("transactionid"): text(),
        _context("paymenttype"): text(),
        _context("currencytype"): text(enum=CURRENCIES),
        _context("currencyamount"): {"required": True, "type": "number"},
        _context("paymentstatus"): {"type": "boolean"},
    }
    level = {_context("level"): {"required": True, "type": "integer", "gt": 0}}
    who = {"xwho": text()}
    named = {"register": {}, "payment": payment, "levelup": level, "login": {}, "enterserver": {}}
    user = RuleBook({"fields": who}, {event: {"fields": rules} for event, rules in named.items()})
    return RuleBook({"fields": default}, groups={"user": user})
