"""The field-check language: chained checks compiled to error columns.

A check column is NULL when the check passes and the error text when it fails, so
``coalesce`` over a chain yields the first failure. Checks are written against
symbolic fields; ``Fields`` supplies the extracted columns of one event version.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.functions.regexes import searched
from eventrail.functions.temporal import compile_format

NOT_AN_OBJECT = "event is not an object"


class Fields(Protocol):
    """Columns extracted once per path from one version of the event."""

    def value(self, path: str) -> Column: ...

    def present(self, path: str) -> Column: ...

    def is_object(self, path: str) -> Column: ...

    def kind(self, path: str) -> Column: ...

    def text(self, path: str) -> Column: ...

    def number(self, path: str) -> Column: ...


Compiled = Callable[[Fields], Column]


def number_text(threshold: float) -> str:
    """Shortest decimal spelling without an exponent or a zero fraction."""
    value = float(threshold)
    if value.is_integer():
        return str(int(value))
    return format(Decimal(repr(value)), "f")


def _error(text: str) -> Column:
    return F.lit(text)


def _first(columns: list[Column]) -> Column:
    if not columns:
        return F.lit(None).cast("string")
    return columns[0] if len(columns) == 1 else F.coalesce(*columns)


@dataclass(frozen=True)
class Cond:
    """A boolean over the event, usable in ``If``."""

    compile: Compiled
    paths: frozenset[str]

    def __and__(self, other: Cond) -> Cond:
        return Cond(lambda f: self.compile(f) & other.compile(f), self.paths | other.paths)

    def __or__(self, other: Cond) -> Cond:
        return Cond(lambda f: self.compile(f) | other.compile(f), self.paths | other.paths)

    def __invert__(self) -> Cond:
        return Cond(lambda f: ~self.compile(f), self.paths)


class Step:
    """Something that may fail with an error text."""

    def paths(self) -> frozenset[str]:
        raise NotImplementedError

    def error(self, fields: Fields) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Field(Step):
    """A field reference with its chained checks."""

    path: str
    needed: bool = False
    folds_case: bool = False
    is_text: bool = False
    checks: tuple[Compiled, ...] = ()

    def paths(self) -> frozenset[str]:
        return frozenset([self.path])

    def error(self, fields: Fields) -> Column:
        chain = [check(fields) for check in self.checks]
        present = fields.present(self.path)
        if self.needed:
            missing = _error(f"missing required field `{self.path}`")
            return _first([F.when(~present, missing), *chain])
        if not chain:
            return F.lit(None).cast("string")
        return F.when(present, _first(chain))

    def _then(self, check: Compiled, **changes) -> Field:
        return replace(self, checks=(*self.checks, check), **changes)

    # Types -----------------------------------------------------------------

    def _typed(self, name: str, test: Compiled) -> Field:
        message = f"field `{self.path}` expected type `{name}`"
        # The last type named decides what later checks may follow.
        return self._then(
            lambda f: F.when(~test(f), _error(message)), is_text=(name == "String")
        )

    def string(self) -> Field:
        return self._typed("String", lambda f: f.kind(self.path) == "STRING")

    def number(self) -> Field:
        return self._typed("Number", lambda f: jsonx.is_number(f.kind(self.path)))

    def integer(self) -> Field:
        return self._typed(
            "Integer", lambda f: jsonx.is_integer(f.kind(self.path), f.value(self.path))
        )

    def boolean(self) -> Field:
        return self._typed("Boolean", lambda f: f.kind(self.path) == "BOOLEAN")

    def object(self) -> Field:
        return self._typed("Object", lambda f: f.is_object(self.path))

    def array(self) -> Field:
        return self._typed("Array", lambda f: jsonx.is_array(f.kind(self.path)))

    # Text ------------------------------------------------------------------

    def min(self, length: int) -> Field:
        message = f"field `{self.path}` length must be at least {length}"
        return self._then(
            lambda f: F.when(F.char_length(f.text(self.path)) < max(length, 0), _error(message))
        )

    def ignore_case(self) -> Field:
        return replace(self, folds_case=True)

    def _follows_string(self, what: str) -> None:
        if not self.is_text:
            raise ValueError(f"{what} for field `{self.path}` must follow string()")

    def enum(self, values: Iterable[str]) -> Field:
        allowed = list(values)
        self._follows_string("enum")
        if not all(isinstance(value, str) for value in allowed):
            raise ValueError(f"enum values for field `{self.path}` must all be strings")
        if not allowed:
            raise ValueError(f"enum values for field `{self.path}` must not be empty")
        return self._member(allowed, self.folds_case)

    def one_of(self, values: Iterable[object]) -> Field:
        allowed = [value for value in values if isinstance(value, str)]
        wrong_type = f"field `{self.path}` expected type `String`"
        typed = self._then(
            lambda f: F.when(f.kind(self.path) != "STRING", _error(wrong_type))
        )
        return typed._member(allowed, True)

    def _member(self, allowed: list[str], folds: bool) -> Field:
        message = f"field `{self.path}` must be one of [{', '.join(allowed)}]"

        def check(f: Fields) -> Column:
            text = f.text(self.path)
            if folds:
                return F.when(
                    ~jsonx.ascii_lower(text).isin([_fold(value) for value in allowed]),
                    _error(message),
                )
            return F.when(~text.isin(allowed), _error(message))

        if not allowed:
            return self._then(lambda f: F.when(f.text(self.path).isNotNull(), _error(message)))
        return self._then(check)

    def matches(self, pattern: str) -> Field:
        self._follows_string("regex")
        found = searched(pattern, self.folds_case)
        message = f"field `{self.path}` must match regex `{pattern}`"
        return self._then(
            lambda f: F.when(~found.column(f.text(self.path)), _error(message))
        )

    def date(self, text: str) -> Field:
        return self._temporal("date", text)

    def time(self, text: str) -> Field:
        return self._temporal("time", text)

    def datetime(self, text: str) -> Field:
        return self._temporal("datetime", text)

    def _temporal(self, what: str, text: str) -> Field:
        self._follows_string(what)
        compiled = compile_format(what, text)
        message = f"field `{self.path}` must be a valid {what} matching format `{text}`"
        return self._then(
            lambda f: F.when(~compiled.is_valid(f.text(self.path)), _error(message))
        )

    # Numbers ---------------------------------------------------------------

    def gt(self, threshold: float) -> Field:
        return self._compare("greater than", threshold, lambda n, t: n > t)

    def gte(self, threshold: float) -> Field:
        return self._compare("greater than or equal to", threshold, lambda n, t: n >= t)

    def lt(self, threshold: float) -> Field:
        return self._compare("less than", threshold, lambda n, t: n < t)

    def lte(self, threshold: float) -> Field:
        return self._compare("less than or equal to", threshold, lambda n, t: n <= t)

    def _compare(self, words: str, threshold: float, holds) -> Field:
        wrong_type = f"field `{self.path}` could not be represented as f64"
        message = f"field `{self.path}` must be {words} {number_text(threshold)}"
        limit = float(threshold)

        def check(f: Fields) -> Column:
            number = f.number(self.path)
            return F.when(number.isNull(), _error(wrong_type)).when(
                ~holds(number, F.lit(limit)), _error(message)
            )

        return self._then(check)

    # Reads -----------------------------------------------------------------

    def _cond(self, compile: Compiled) -> Cond:
        return Cond(lambda f: F.coalesce(compile(f), F.lit(False)), self.paths())

    def eq(self, expected: object) -> Cond:
        """JSON equality; text honours ``ignore_case``; a missing field equals nothing."""
        path = self.path
        if expected is None:
            return self._cond(lambda f: F.is_variant_null(f.value(path)))
        if isinstance(expected, str):
            if self.folds_case:
                return self._cond(lambda f: jsonx.ascii_lower(f.text(path)) == _fold(expected))
            return self._cond(lambda f: f.text(path) == expected)
        if isinstance(expected, bool):
            return self._cond(
                lambda f: (f.kind(path) == "BOOLEAN")
                & (F.try_variant_get(f.value(path), "$", "boolean") == expected)
            )
        if isinstance(expected, int):
            exact = F.lit(str(expected)).cast("decimal(20,0)")
            return self._cond(
                lambda f: jsonx.is_integer(f.kind(path), f.value(path))
                & (F.try_variant_get(f.value(path), "$", "decimal(20,0)") == exact)
            )
        if isinstance(expected, float):
            return self._cond(
                lambda f: ~jsonx.is_integer(f.kind(path), f.value(path))
                & (f.number(path) == expected)
            )
        return self._cond(lambda f: _equals(f.value(path), expected))

    def exists(self) -> Cond:
        """Present, not null and not the empty string."""
        return self._cond(lambda f: filled(f, self.path))

    def missing(self) -> Cond:
        return ~self.exists()

    def value(self) -> FieldValue:
        return FieldValue(self.path)


def _equals(value: Column, expected: object) -> Column:
    """JSON equality of a VARIANT with a constant: kind and value of every leaf."""
    kind = jsonx.kind(value)
    if expected is None:
        same = F.is_variant_null(value)
    elif isinstance(expected, str):
        same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == expected)
    elif isinstance(expected, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == expected)
    elif isinstance(expected, int):
        exact = F.lit(str(expected)).cast("decimal(20,0)")
        same = jsonx.is_integer(kind, value) & (F.try_variant_get(value, "$", "decimal(20,0)") == exact)
    elif isinstance(expected, float):
        number = F.try_variant_get(value, "$", "double")
        same = jsonx.is_number(kind) & ~jsonx.is_integer(kind, value) & (number == expected)
    elif isinstance(expected, dict):
        found = jsonx.members(value)
        same = jsonx.is_object(kind) & (F.size(found) == len(expected))
        for key, item in expected.items():
            same = same & _equals(F.try_element_at(found, F.lit(key)), item)
    else:
        found = F.try_variant_get(value, "$", "array<variant>")
        same = jsonx.is_array(kind) & (F.size(found) == len(expected))
        for place, item in enumerate(expected):
            same = same & _equals(F.get(found, F.lit(place)), item)
    return F.coalesce(same, F.lit(False))


def _fold(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def filled(fields: Fields, path: str) -> Column:
    blank = F.coalesce(fields.text(path) == "", F.lit(False))
    return fields.present(path) & ~blank


@dataclass(frozen=True)
class AnyOf:
    """A group of fields of which one may be demanded."""

    names: tuple[str, ...]

    def required(self) -> AnyRequired:
        return AnyRequired(self.names)


@dataclass(frozen=True)
class AnyRequired(Step):
    names: tuple[str, ...]

    def paths(self) -> frozenset[str]:
        return frozenset(self.names)

    def error(self, fields: Fields) -> Column:
        message = f"at least one field is required: {', '.join(self.names)}"
        if not self.names:
            return _error(message)
        some = reduce(lambda a, b: a | b, [filled(fields, name) for name in self.names])
        return F.when(~some, _error(message))


@dataclass(frozen=True)
class If(Step):
    """Conditional steps; inside a processor the branches may hold any statement."""

    condition: Cond
    then: tuple = ()
    otherwise: tuple = ()

    def paths(self) -> frozenset[str]:
        inner = [step.paths() for step in (*self.then, *self.otherwise)]
        return self.condition.paths.union(*inner)

    def error(self, fields: Fields) -> Column:
        condition = self.condition.compile(fields)
        error = F.when(condition, first_error(self.then, fields))
        if self.otherwise:
            error = error.otherwise(first_error(self.otherwise, fields))
        return error


def when(condition: Cond, *then, otherwise=()) -> If:
    return If(condition, tuple(then), tuple(otherwise))


@dataclass(frozen=True)
class FieldValue:
    """The raw value of a field as a VARIANT, NULL when missing."""

    path: str
    change: Callable[[Column], Column] | None = field(default=None, compare=False)

    def paths(self) -> frozenset[str]:
        return frozenset([self.path])

    def lower(self) -> FieldValue:
        return FieldValue(self.path, F.lower)

    def upper(self) -> FieldValue:
        return FieldValue(self.path, F.upper)

    def compile(self, fields: Fields) -> Column:
        if self.change is None:
            return fields.value(self.path)
        return self.change(fields.text(self.path)).cast("variant")


class Event:
    """Entry points of the language; the event itself is implied."""

    @staticmethod
    def field(path: str) -> Field:
        return Field(path)

    @staticmethod
    def required(path: str) -> Field:
        return Field(path, needed=True)

    @staticmethod
    def optional(path: str) -> Field:
        return Field(path)

    @staticmethod
    def any(paths: Iterable[object]) -> AnyOf:
        return AnyOf(tuple(path for path in paths if isinstance(path, str)))

    @staticmethod
    def contains(key: str) -> Cond:
        """Whether the event has the key at all, JSON null included."""
        return Cond(lambda f: f.value(key).isNotNull(), frozenset([key]))


def first_error(steps: Iterable[Step], fields: Fields) -> Column:
    return _first([step.error(fields) for step in steps])


def all_paths(steps: Iterable[Step]) -> frozenset[str]:
    return frozenset().union(*[step.paths() for step in steps])


# The phrases of error texts, in the order in which they are looked for, and their codes.
# The texts themselves are fixed as well, wherever this module words one.
ERROR_STARTS = {
    "missing required field `": "rules_required_field_missing",
    "at least one field is required: ": "rules_conditional_required_missing",
}
ERROR_PHRASES = {
    "expected type `": "rules_field_type_mismatch",
    "must be one of [": "rules_enum_value_invalid",
    "could not be represented as f64": "rules_number_parse_failed",
    "must be greater than ": "rules_number_constraint_failed",
    "must be greater than or equal to ": "rules_number_constraint_failed",
    "must be less than ": "rules_number_constraint_failed",
    "must be less than or equal to ": "rules_number_constraint_failed",
}
OTHER_ERROR = "rules_script_execution_failed"


def classify_error(error: Column) -> Column:
    """Stable code of an error text; NULL for no error."""
    code = F.when(error.isNull(), F.lit(None).cast("string"))
    for start, name in ERROR_STARTS.items():
        code = code.when(error.startswith(start), name)
    for phrase, name in ERROR_PHRASES.items():
        code = code.when(error.contains(phrase), name)
    return code.otherwise(OTHER_ERROR)
