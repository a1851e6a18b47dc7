"""Event processors declared as statements and compiled to columns.

A processor checks, rewrites and emits one event. Its statements run in order:

* a check step that fails raises its error text,
* ``Set`` rewrites the event, which stays rewritten when a later step fails,
* ``Emit`` snapshots the event for a sink; what was emitted before a caught error
  stays, an uncaught error discards the whole record,
* ``Try`` catches the first error of its body and runs its handler.

Nothing here touches rows: statements become guarded columns, every needed field is
extracted once, and a rewritten event is put together once, where it is emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.functions.checks import (
    NOT_AN_OBJECT,
    Cond,
    FieldValue,
    If,
    Step,
    all_paths,
    classify_error,
    first_error,
)
from eventrail.functions.extract import Extracted
from eventrail.functions.names import check_targets

DELIVERY_TYPE = "array<struct<target:string,event_json:string>>"


class Value:
    """Something ``Set`` can store; compiles to a VARIANT, NULL for nothing."""

    def paths(self) -> frozenset[str]:
        return frozenset()

    def compile(self, fields: Extracted, caught: Column | None) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Literal(Value):
    content: object

    def compile(self, fields, caught):
        return F.lit(self.content).cast("variant")


@dataclass(frozen=True)
class RequestValue(Value):
    """A column of the record: ip, method, path, request id, receive time."""

    column: str

    def compile(self, fields, caught):
        return F.col(self.column).cast("variant")


@dataclass(frozen=True)
class HeaderValue(Value):
    name: str

    def compile(self, fields, caught):
        headers = F.transform_keys("headers", lambda k, _: F.lower(k))
        return F.try_element_at(headers, F.lit(self.name.lower())).cast("variant")


class Request:
    """Accessors of the request an event came with."""

    @staticmethod
    def ip() -> Value:
        return RequestValue("remote_addr")

    @staticmethod
    def method() -> Value:
        return RequestValue("method")

    @staticmethod
    def path() -> Value:
        return RequestValue("path")

    @staticmethod
    def request_id() -> Value:
        return RequestValue("record_id")

    @staticmethod
    def received_at_ms() -> Value:
        return RequestValue("received_at_ms")

    @staticmethod
    def header(name: str) -> Value:
        return HeaderValue(name)

    @staticmethod
    def has_ip() -> Cond:
        return Cond(lambda _: F.col("remote_addr").isNotNull(), frozenset())


@dataclass(frozen=True)
class EpochMs(Value):
    def compile(self, fields, caught):
        return F.unix_millis(F.current_timestamp()).cast("variant")


@dataclass(frozen=True)
class ErrorText(Value):
    """The caught error, inside a handler."""

    def compile(self, fields, caught):
        if caught is None:
            raise ValueError("error text is only known inside a handler")
        return caught.cast("variant")


@dataclass(frozen=True)
class ErrorCode(Value):
    """The stable code of the caught error, inside a handler."""

    def compile(self, fields, caught):
        if caught is None:
            raise ValueError("error code is only known inside a handler")
        return classify_error(caught).cast("variant")


@dataclass(frozen=True)
class ObjectValue(Value):
    members: Mapping[str, Value | FieldValue]

    def paths(self):
        return frozenset().union(*[_value_paths(v) for v in self.members.values()])

    def compile(self, fields, caught):
        null = F.parse_json(F.lit("null"))
        pairs: list[Column] = []
        for name, value in self.members.items():
            pairs += [F.lit(name), F.coalesce(_compile_value(value, fields, caught), null)]
        return F.to_variant_object(F.create_map(*pairs)) if pairs else F.parse_json(F.lit("{}"))


def _value_paths(value) -> frozenset[str]:
    return value.paths()


def _compile_value(value, fields: Extracted, caught: Column | None) -> Column:
    return value.compile(fields) if isinstance(value, FieldValue) else value.compile(fields, caught)


@dataclass(frozen=True)
class Set:
    path: str
    value: Value | FieldValue

    def paths(self) -> frozenset[str]:
        return self.value.paths() | {self.path}


@dataclass(frozen=True)
class Emit:
    target: str

    def paths(self) -> frozenset[str]:
        return frozenset()


@dataclass(frozen=True)
class Try:
    body: tuple
    catch: tuple

    def paths(self) -> frozenset[str]:
        return all_paths((*self.body, *self.catch))


def attempt(*body, catch: Iterable = ()) -> Try:
    return Try(tuple(body), tuple(catch))


@dataclass(frozen=True)
class Processor:
    key: str
    statements: tuple

    def targets(self) -> list[str]:
        """Every target the processor may emit to, in order of appearance."""
        return list(dict.fromkeys(_targets(self.statements)))

    def check_targets(self, sinks: Iterable[str]) -> None:
        """Refuse a processor that emits to a sink that is not configured."""
        check_targets(self.key, self.targets(), sinks)


def processor(key: str, *statements) -> Processor:
    return Processor(key, tuple(statements))


def _targets(statements) -> Iterable[str]:
    for statement in statements:
        if isinstance(statement, Emit):
            yield statement.target
        elif isinstance(statement, If):
            yield from _targets((*statement.then, *statement.otherwise))
        elif isinstance(statement, Try):
            yield from _targets((*statement.body, *statement.catch))


def _only_checks(statement) -> bool:
    if isinstance(statement, If):
        return all(_only_checks(inner) for inner in (*statement.then, *statement.otherwise))
    return isinstance(statement, Step)


@dataclass
class _Scope:
    """The error column of the innermost ``Try`` (or of the processor)."""

    error: str | None = None


class _Overlaid:
    """Fields of an event under pending rewrites, without rebuilding the event."""

    def __init__(self, base: Extracted, rewrites: Mapping[str, str]):
        self._base = base
        self._rewrites = rewrites

    def _either(self, path: str, new: Callable[[Column], Column], old: Column) -> Column:
        if path not in self._rewrites:
            return old
        value = F.col(self._rewrites[path])
        return F.when(value.isNotNull(), new(value)).otherwise(old)

    def value(self, path: str) -> Column:
        return self._either(path, lambda v: v, self._base.value(path))

    def present(self, path: str) -> Column:
        return self._either(path, lambda v: ~F.is_variant_null(v), self._base.present(path))

    def kind(self, path: str) -> Column:
        return self._either(path, jsonx.kind, self._base.kind(path))

    def text(self, path: str) -> Column:
        def new(value: Column) -> Column:
            is_text = jsonx.kind(value) == "STRING"
            return F.when(is_text, F.try_variant_get(value, "$", "string"))

        return self._either(path, new, self._base.text(path))

    def number(self, path: str) -> Column:
        def new(value: Column) -> Column:
            is_number = jsonx.is_number(jsonx.kind(value))
            return F.when(is_number, F.try_variant_get(value, "$", "double"))

        return self._either(path, new, self._base.number(path))

    def is_object(self, path: str | None = None) -> Column:
        old = self._base.is_object(path)
        if path is None:
            return old
        return self._either(path, lambda v: jsonx.is_object(jsonx.kind(v)), old)


def _clashes(path: str, other: str) -> bool:
    return path.startswith(other + ".") or other.startswith(path + ".")


@dataclass
class _Compiler:
    """State while the statements of one processor become columns.

    Rewrites are kept as one column per path, NULL where not applied. The event is
    rebuilt from them only when it is emitted or read at a path above or below one.
    """

    df: DataFrame
    tag: str
    event: str
    body: str
    base: Extracted
    hidden: list[str] = field(default_factory=list)
    emits: list[tuple[Column | None, str, Column]] = field(default_factory=list)
    rewrites: dict[str, str] = field(default_factory=dict)
    rewritten: str | None = None
    text: str | None = None

    def _name(self, what: str) -> str:
        name = f"__{self.tag}_{what}{len(self.hidden)}"
        self.hidden.append(name)
        return name

    def _add(self, what: str, column: Column) -> str:
        name = self._name(what)
        self.df = self.df.withColumn(name, column)
        return name

    def _fields(self, paths: frozenset[str]) -> _Overlaid:
        if any(_clashes(path, done) for path in paths for done in self.rewrites):
            self._rebuild()
        return _Overlaid(self.base, self.rewrites)

    def _applied(self, names: Iterable[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in names])

    def _current(self) -> Column:
        """The event with all pending rewrites."""
        if not self.rewrites:
            return F.col(self.event)
        tree: dict = {}
        for path, name in self.rewrites.items():
            node = tree
            *above, last = path.split(".")
            for part in above:
                node = node.setdefault(part, {})
            node[last] = name
        whole = self._merged(F.col(self.event), tree, "")
        return F.when(self._applied(self.rewrites.values()), whole).otherwise(F.col(self.event))

    def _merged(self, value: Column, tree: dict, prefix: str) -> Column:
        none = F.create_map().cast("map<string,variant>")
        kept = F.map_filter(jsonx.members(value), lambda k, _: ~k.isin(list(tree)))
        pairs: list[Column] = []
        for key, node in tree.items():
            path = prefix + key
            old = self.base.value(path)
            if isinstance(node, str):
                new = F.coalesce(F.col(node), old)
            else:
                below = [n for p, n in self.rewrites.items() if p.startswith(path + ".")]
                inner = self._merged(old, node, path + ".")
                new = F.when(self._applied(below), inner).otherwise(old)
            pairs += [F.lit(key), new]
        added = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        return F.to_variant_object(F.map_concat(F.coalesce(kept, none), added))

    def _rebuild(self) -> None:
        """Fold the pending rewrites into a new event column and extract from that."""
        applied = self._applied(self.rewrites.values())
        if self.rewritten is not None:
            applied = applied | F.col(self.rewritten)
        self.rewritten = self._add("w", applied)
        self.event = self._add("v", self._current())
        self.base = Extracted(self.event, f"{self.tag}n{len(self.hidden)}", self.base.paths)
        self.df = self.base.attach(self.df)
        self.hidden += self.base.columns()
        self.rewrites = {}

    def _text(self) -> Column:
        """Text of the current event: the body itself as long as nothing was rewritten."""
        if self.text is None:
            changed = [F.col(name).isNotNull() for name in self.rewrites.values()]
            if self.rewritten is not None:
                changed.append(F.col(self.rewritten))
            if not changed:
                return F.col(self.body)
            any_change = reduce(lambda a, b: a | b, changed)
            printed = F.to_json(self._current())
            self.text = self._add("t", F.when(any_change, printed).otherwise(F.col(self.body)))
        return F.col(self.text)

    @staticmethod
    def _alive(guard: Column | None, scope: _Scope) -> Column | None:
        if scope.error is None:
            return guard
        clear = F.col(scope.error).isNull()
        return clear if guard is None else guard & clear

    def _raise(self, scope: _Scope, guard: Column | None, error: Column) -> None:
        guarded = error if guard is None else F.when(guard, error)
        if scope.error is not None:
            guarded = F.coalesce(F.col(scope.error), guarded)
        scope.error = self._add("e", guarded)

    def run(self, statements, guard: Column | None, scope: _Scope, caught: Column | None) -> None:
        checks: list[Step] = []
        for statement in statements:
            if _only_checks(statement):
                checks.append(statement)
                continue
            self._check(checks, guard, scope)
            checks = []
            if isinstance(statement, Emit):
                if statement.target.strip():
                    self.emits.append((self._alive(guard, scope), statement.target, self._text()))
            elif isinstance(statement, Set):
                self._set(statement, guard, scope, caught)
            elif isinstance(statement, If):
                self._branch(statement, guard, scope, caught)
            elif isinstance(statement, Try):
                inner = _Scope()
                self.run(statement.body, self._alive(guard, scope), inner, caught)
                if inner.error is not None:
                    failed = F.col(inner.error).isNotNull()
                    entered = failed if guard is None else guard & failed
                    self.run(statement.catch, entered, scope, F.col(inner.error))
            else:
                raise TypeError(f"not a statement: {statement!r}")
        self._check(checks, guard, scope)

    def _check(self, checks: list[Step], guard: Column | None, scope: _Scope) -> None:
        if not checks:
            return
        fields = self._fields(all_paths(checks))
        not_object = F.when(~fields.is_object(), F.lit(NOT_AN_OBJECT))
        self._raise(scope, guard, F.coalesce(not_object, first_error(checks, fields)))

    def _set(self, statement: Set, guard, scope: _Scope, caught) -> None:
        path = statement.path
        fields = self._fields(statement.value.paths() | {path})
        self._raise(scope, guard, self._refusal(statement, fields))
        null = F.parse_json(F.lit("null"))
        new = F.coalesce(_compile_value(statement.value, fields, caught), null)
        alive = self._alive(guard, scope)
        column = new if alive is None else F.when(alive, new)
        if path in self.rewrites:
            column = F.coalesce(column, F.col(self.rewrites[path]))
        self.rewrites = {**self.rewrites, path: self._add("s", column)}
        self.text = None

    def _refusal(self, statement: Set, fields: _Overlaid) -> Column:
        """Error of a rewrite: a container that is no object, a value without the type."""
        fits = self.base.is_object()
        above = statement.path.split(".")[:-1]
        for depth in range(1, len(above) + 1):
            container = ".".join(above[:depth])
            fits = fits & (self.base.is_object(container) | ~self.base.present(container))
        text = f"cannot set field `{statement.path}` on a value that is no object"
        error = F.when(~fits, F.lit(text))
        if statement.value.paths():
            error = F.coalesce(F.when(~self.base.is_object(), F.lit(NOT_AN_OBJECT)), error)
        if isinstance(statement.value, FieldValue) and statement.value.change is not None:
            source = statement.value.path
            no_text = fields.text(source).isNull()
            error = F.coalesce(error, F.when(no_text, F.lit(f"field `{source}` is not a string")))
        return error

    def _branch(self, statement: If, guard, scope: _Scope, caught) -> None:
        fields = self._fields(statement.condition.paths)
        if statement.condition.paths:
            # Reading a field of an event that is no object fails before any branch is taken.
            self._raise(scope, guard, F.when(~fields.is_object(), F.lit(NOT_AN_OBJECT)))
        taken = F.col(self._add("b", statement.condition.compile(fields)))
        outer = self._alive(guard, scope)
        self.run(statement.then, taken if outer is None else outer & taken, scope, caught)
        if statement.otherwise:
            outer = self._alive(guard, scope)
            self.run(statement.otherwise, ~taken if outer is None else outer & ~taken, scope, caught)


def process(
    df: DataFrame,
    processors: Mapping[str, Processor],
    script: str = "script_key",
    event: str = "event",
    text: str = "body",
) -> DataFrame:
    """Run each record's processor; adds ``deliveries`` and ``processor_error``.

    All processors are evaluated in one pass over the records. Version-zero fields
    are extracted once for all of them. ``deliveries`` may hold NULL entries, one for
    each emit that did not happen; the position keeps the emit order.
    """
    everything = frozenset().union(*[all_paths(p.statements) for p in processors.values()])
    base = Extracted(event, "base", everything)
    df = base.attach(df)
    hidden = base.columns()
    deliveries = F.lit(None).cast(DELIVERY_TYPE)
    error = F.lit(None).cast("string")
    for index, (key, item) in enumerate(processors.items()):
        guard = None if len(processors) == 1 else F.col(script) == key
        compiler = _Compiler(df, f"p{index}", event, text, base)
        scope = _Scope()
        compiler.run(item.statements, guard, scope, None)
        df = compiler.df
        hidden += compiler.hidden
        emitted = F.array(*[_delivery(*emit) for emit in compiler.emits]).cast(DELIVERY_TYPE)
        failed = F.lit(None).cast("string") if scope.error is None else F.col(scope.error)
        if guard is None:
            deliveries, error = emitted, failed
        else:
            deliveries = F.when(guard, emitted).otherwise(deliveries)
            error = F.when(guard, failed).otherwise(error)
    return df.withColumns({"deliveries": deliveries, "processor_error": error}).drop(*hidden)


def _delivery(condition: Column | None, target: str, text: Column) -> Column:
    entry = F.struct(F.lit(target).alias("target"), text.alias("event_json"))
    return entry if condition is None else F.when(condition, entry)
