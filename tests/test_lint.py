"""Targets of processors, declared and written in Python, are checked before they run."""

import functools

import pytest

from eventrail.functions.checks import Event, when
from eventrail.plans.lint import check_processors, findings, sink_names
from eventrail.plans.processor import Emit, attempt, processor

SINKS = ["events", "events_error"]
names = sink_names(SINKS)
SINK_EVENTS, SINK_EVENTS_ERROR, SINK_OTHER = names.SINK_EVENTS, names.SINK_EVENTS_ERROR, "other"
LEVELS = {"a": "events"}


def good(event, request, emit):
    emit(SINK_EVENTS, event)
    if event.get("bad"):
        send = emit
        send(target=names.SINK_EVENTS_ERROR, event={})
    [emit(SINK_EVENTS, part) for part in event.get("parts", ())]


def to_helper(event, request, emit):
    helper(event, emit)
    ROUTER.route(event, send=emit)
    (lambda: emit(SINK_EVENTS, event))()


def helper(event, emit, depth=0):
    emit(SINK_EVENTS, event)
    if depth < 3:
        helper(event, emit, depth + 1)


class Router:
    def route(self, event, send):
        send(SINK_EVENTS, event)

    def __call__(self, event, request, emit):
        emit(SINK_EVENTS, event)


ROUTER = Router()


def bad_helper(event, emit):
    emit("nowhere", event)


def literal(event, request, emit):
    emit("events", event)


def unknown_literal(event, request, emit):
    bad_helper(event, emit)


def unknown_constant(event, request, emit):
    emit(SINK_OTHER, event)


def computed(event, request, emit):
    target = SINK_EVENTS
    emit(target, event)
    emit(LEVELS["a"], event)
    emit(SINK_EVENTS if event else SINK_EVENTS_ERROR, event)


def nothing(event, request, emit):
    emit()


def shadowed(event, request, emit):
    SINK_EVENTS = event["to"]
    emit(SINK_EVENTS, event)


def escaping(event, request, emit):
    event["later"] = emit
    map(emit, event)
    event["f"](emit)


def own_name(event, request, emit):
    def inner(emit):
        emit("not a sink", event)

    inner(print)
    emit(SINK_EVENTS, event)


def messages(function):
    return [m.rsplit(" (line", 1)[0] for _, m in findings({"p": function}, SINKS)]


def test_good_functions():
    partial = functools.partial(lambda extra, event, request, emit: emit(SINK_EVENTS, event), 1)
    for function in (good, to_helper, Router(), own_name, lambda e, r, emit: emit(SINK_EVENTS, e), partial):
        assert messages(function) == []


@pytest.mark.parametrize(("function", "want"), [
    (literal, ["emit target must use sink constant `SINK_EVENTS` instead of text"]),
    (unknown_literal, ["unknown sink target `nowhere`"]),
    (unknown_constant, ["unknown sink target constant `SINK_OTHER`"]),
    (computed, ["unknown sink target constant `target`", *["emit target must be a configured sink constant"] * 2]),
    (nothing, ["emit(target, event) requires a sink target constant"]),
    (shadowed, ["constant `SINK_EVENTS` does not hold sink `events`"]),
    (escaping, ["`emit` may only be called, or handed to a function that can be read",
                "its source cannot be read", "emit may only be handed to a function that can be read"]),
    (print, ["its source cannot be read"]),
    (lambda event, request: None, ["`<lambda>` has no parameter for emit"]),
])
def test_refused_functions(function, want):
    assert messages(function) == want


def test_lines_are_those_of_the_file():
    ((_, message),) = findings({"p": literal}, SINKS)
    assert message.endswith(f"(line {literal.__code__.co_firstlineno + 1})")


def test_declared_processors(spark):
    made = processor("p", attempt(when(Event.field("a").eq(1), Emit("nowhere")), Emit("events"), catch=[Emit("lost")]), Emit(" "))
    assert findings({"p": made, "q": processor("q", Emit("events"))}, SINKS) == [
        ("p", "unknown sink target `nowhere`"), ("p", "unknown sink target `lost`"),
    ]
    with pytest.raises(ValueError, match="failed to check processor `p`: unknown sink target `nowhere`"):
        check_processors({"p": made}, SINKS)
    with pytest.raises(ValueError, match="both map to constant"):
        check_processors({}, ["a.b", "a-b"])
