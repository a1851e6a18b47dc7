"""Validation rules as data: field rules per event name, cascading from a default.

A rule file is a mapping ``{"fields": {path: rule}}``. A rule may hold ``required``,
``type``, ``min``, ``enum``, ``matches``, ``gt``, ``gte``, ``lt``, ``lte``,
``required_when`` and ``required_any_when``. Values are compared ignoring ASCII case.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from eventrail.functions.checks import Event, Field, If, Step, when

_TYPES = ("string", "number", "integer", "boolean", "object", "array")
_KNOWN = {
    "required", "type", "min", "enum", "matches", "gt", "gte", "lt", "lte",
    "required_when", "required_any_when",
}


def field_steps(path: str, rule: Mapping) -> list[Step]:
    unknown = set(rule) - _KNOWN
    if unknown:
        raise ValueError(f"unknown rule keys for field `{path}`: {sorted(unknown)}")
    check = Event.required(path) if rule.get("required") else Event.optional(path)
    check = _chained(check, rule)
    value = Event.field(path).ignore_case()
    steps: list[Step] = [check]
    for group in rule.get("required_any_when", ()):
        steps.append(when(value.eq(group["equals"]), Event.any(group["fields"]).required()))
    for group in rule.get("required_when", ()):
        steps.append(when(value.eq(group["equals"]), *map(Event.required, group["fields"])))
    return steps


def _chained(check: Field, rule: Mapping) -> Field:
    if "type" in rule:
        if rule["type"] not in _TYPES:
            raise ValueError(f"unknown type `{rule['type']}` for field `{check.path}`")
        check = getattr(check, rule["type"])()
    if "min" in rule:
        check = check.min(rule["min"])
    if "enum" in rule:
        check = check.ignore_case().enum(rule["enum"])
    if "matches" in rule:
        check = check.matches(rule["matches"])
    for bound in ("gt", "gte", "lt", "lte"):
        if bound in rule:
            check = getattr(check, bound)(rule[bound])
    return check


def file_steps(rules: Mapping | None) -> list[Step]:
    """Steps of one rule file, in the order of its fields."""
    fields = (rules or {}).get("fields") or {}
    return [step for path, rule in fields.items() for step in field_steps(path, rule or {})]


@dataclass(frozen=True)
class RuleBook:
    """``default`` applies to all events, then a group's default, then the event's own."""

    default: Mapping
    events: Mapping[str, Mapping] = field(default_factory=dict)
    groups: Mapping[str, RuleBook] = field(default_factory=dict)

    def steps(self, event_name: str = "xwhat") -> list[Step]:
        return [*file_steps(self.default), *self._own(Event.field(event_name))]

    def names(self) -> list[str]:
        found = list(self.events)
        for group in self.groups.values():
            found += group.names()
        return list(dict.fromkeys(found))

    def _own(self, name: Field) -> list[If]:
        steps = [when(name.eq(event), *file_steps(rules)) for event, rules in self.events.items()]
        for group in self.groups.values():
            members = group.names()
            if not members:
                continue
            inside = name.eq(members[0])
            for member in members[1:]:
                inside = inside | name.eq(member)
            steps.append(when(inside, *file_steps(group.default), *group._own(name)))
        return steps


def _read(path: Path) -> Mapping:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError(f"reading {path.name} needs a YAML package; JSON does not") from error
    return yaml.safe_load(text) or {}


def load_rule_book(folder: str | Path) -> RuleBook:
    """Rules of a folder: ``default``, one file per event name, one subfolder per group."""
    default: Mapping = {}
    events, groups = {}, {}
    for path in sorted(Path(folder).iterdir()):
        if path.is_dir():
            groups[path.name] = load_rule_book(path)
        elif path.suffix in (".json", ".yaml", ".yml"):
            if path.stem == "default":
                default = _read(path)
            else:
                events[path.stem] = _read(path)
    return RuleBook(default, events, groups)
