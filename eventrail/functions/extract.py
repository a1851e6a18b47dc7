"""Extract the fields a set of checks needs, once per path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrail.functions import jsonx
from eventrail.functions.checks import Step, all_paths, first_error
from eventrail.functions.fence import compute_once
from eventrail.functions.paths import field_path

_PREFIX = "__f"


class Extracted:
    """Columns of one event version.

    The members needed of one object are taken in a single pass, as a struct of VARIANTs;
    the struct is NULL exactly when the value is no object. Nested objects follow level
    by level. Kinds and texts are read from each member once, where the struct is taken apart:
    every VARIANT carries all names of its event, so few of them are passed on.
    """

    def __init__(self, event: str, tag: str, paths: Iterable[str]):
        self.event = event
        self.paths = frozenset(paths)
        tag = f"{_PREFIX}{tag}"
        # Member paths by object path; the event itself is the object ``None``.
        self._members: dict[str | None, list[str]] = {None: []}
        for path in sorted(self.paths):
            self._add(path)
        every = sorted(member for members in self._members.values() for member in members)
        self._names: dict[str | None, str] = {p: f"{tag}_{i}" for i, p in enumerate(every)}
        self._names[None] = f"{tag}_event"
        self._present: dict[str, Column] = {}

    def _add(self, path: str) -> None:
        parent = path.rpartition(".")[0] if "." in path else None
        if parent not in self._members:
            self._members[parent] = []
            self._add(parent)
        if path not in self._members[parent]:
            self._members[parent].append(path)

    def value(self, path: str) -> Column:
        return F.col(self._names[path])

    def present(self, path: str) -> Column:
        """Neither missing nor JSON null; never NULL itself."""
        if path not in self._present:
            if path in self.paths:
                self._present[path] = F.coalesce(self.kind(path) != "VOID", F.lit(False))
            else:
                value = self.value(path)
                self._present[path] = value.isNotNull() & ~F.is_variant_null(value)
        return self._present[path]

    def kind(self, path: str) -> Column:
        return F.col(self._names[path] + "k")

    def text(self, path: str) -> Column:
        return F.col(self._names[path] + "s")

    def number(self, path: str) -> Column:
        return F.when(
            jsonx.is_number(self.kind(path)), F.try_variant_get(self.value(path), "$", "double")
        )

    def is_object(self, path: str | None = None) -> Column:
        """Whether the value (the event itself without a path) is an object."""
        if path in self._members:
            return F.col(self._names[path] + "o")
        return F.coalesce(jsonx.is_object(self.kind(path)), F.lit(False))

    def _levels(self) -> list[list[str | None]]:
        """Object paths by depth, the event first."""
        depth = {p: 0 if p is None else p.count(".") + 1 for p in self._members}
        return [
            [path for path in self._members if depth[path] == level]
            for level in range(max(depth.values()) + 1)
        ]

    def attach(self, df: DataFrame) -> DataFrame:
        for objects in self._levels():
            structs, read = {}, {}
            for path in objects:
                source = F.col(self.event if path is None else self._names[path])
                packed = self._names[path] + "o"
                keys = {m: m if path is None else m[len(path) + 1 :] for m in self._members[path]}
                plain = _plain(keys.values())
                structs[packed] = F.try_variant_get(source, "$", _shape(plain))
                for member, key in keys.items():
                    value = F.col(packed).getField(key) if key in plain else jsonx.get(source, field_path(key))
                    name = self._names[member]
                    read[name] = value
                    if member in self.paths:
                        read[name + "k"] = jsonx.kind(value)
                        is_text = jsonx.kind(value) == "STRING"
                        read[name + "s"] = F.when(is_text, F.try_variant_get(value, "$", "string"))
                # From here on only whether there is an object counts.
                read[packed] = F.col(packed).isNotNull()
            df = df.withColumns(structs).withColumns(read)
        return df

    def columns(self) -> list[str]:
        return [n + suffix for n in self._names.values() for suffix in ("", "k", "s", "o")]


def _plain(keys: Iterable[str]) -> list[str]:
    """Keys that can be struct fields: not empty and no two that differ only in case."""
    keys = list(keys)
    folded = [key.lower() for key in keys]
    return [key for key in keys if key and folded.count(key.lower()) == 1]


def _shape(keys: list[str]) -> str:
    if not keys:
        return "map<string,variant>"
    return "struct<" + ", ".join("`" + k.replace("`", "``") + "`: variant" for k in keys) + ">"


def with_error(
    df: DataFrame, steps: Iterable[Step], out: str = "error", event: str = "event"
) -> DataFrame:
    """Add the first error of the steps, NULL for a valid event."""
    steps = list(steps)
    fields = Extracted(event, out, all_paths(steps))
    checked = fields.attach(df).withColumn(out, first_error(steps, fields))
    return compute_once(checked.drop(*fields.columns()), out)


def with_conditions(df: DataFrame, conditions: dict, event: str = "event") -> DataFrame:
    """Add boolean columns, one per named condition."""
    fields = Extracted(event, "c", frozenset().union(*[c.paths for c in conditions.values()]))
    read = {name: condition.compile(fields) for name, condition in conditions.items()}
    return compute_once(fields.attach(df).withColumns(read).drop(*fields.columns()), *read)
