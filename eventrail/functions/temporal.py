"""strftime-style format checks as Spark datetime patterns.

A text is valid when it parses and formats back to exactly the same text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directive -> (part it fills, Spark pattern, regex of its text).
_DIRECTIVES = {
    "Y": ("year", "yyyy", r"[0-9]{4}"),
    "y": ("year", "yy", r"[0-9]{2}"),
    "m": ("month", "MM", r"[0-9]{2}"),
    "b": ("month", "MMM", r"[A-Za-z]{3}"),
    "B": ("month", "MMMM", r"[A-Za-z]{3,9}"),
    "d": ("day", "dd", r"[0-9]{2}"),
    "j": ("yearday", "DDD", r"[0-9]{3}"),
    "H": ("hour", "HH", r"[0-9]{2}"),
    "I": ("hour12", "hh", r"[0-9]{2}"),
    "p": ("half", "a", r"AM|PM"),
    "M": ("minute", "mm", r"[0-9]{2}"),
    "S": ("second", "ss", r"[0-9]{2}"),
    "f": ("nanos", "", r"[0-9]{9}"),
}
_SHORTHANDS = {"F": "%Y-%m-%d", "D": "%m/%d/%y", "T": "%H:%M:%S", "R": "%H:%M"}
_DATE_PARTS = {"year", "month", "day", "yearday"}


@dataclass(frozen=True)
class TemporalFormat:
    """A compiled format for one of ``date``, ``time`` or ``datetime``."""

    kind: str
    text: str
    pattern: str
    regex: str
    parts: frozenset[str]

    @property
    def complete(self) -> bool:
        """Whether the directives determine a value at all."""
        day = {"year", "month", "day"} <= self.parts or {"year", "yearday"} <= self.parts
        clock = "minute" in self.parts and (
            "hour" in self.parts or {"hour12", "half"} <= self.parts
        )
        if "nanos" in self.parts and "second" not in self.parts:
            return False
        return {"date": day, "time": clock, "datetime": day and clock}[self.kind]

    def is_valid(self, text: Column) -> Column:
        """Boolean column; never NULL for a non-null text."""
        if not self.complete:
            return F.lit(False)
        plain = text
        if "nanos" in self.parts:
            plain = F.regexp_replace(plain, self._around("f"), "$1$2")
        if "second" in self.parts:
            # A leap second is a valid reading of the clock.
            plain = F.regexp_replace(plain, self._around("S", "60"), "$159$2")
        pattern, value = self.pattern, plain
        if self.kind == "time":
            pattern, value = "yyyy-MM-dd " + pattern, F.concat(F.lit("2000-01-01 "), plain)
        parsed = F.try_to_timestamp(value, F.lit(pattern))
        round_trip = F.coalesce(F.date_format(parsed, pattern) == value, F.lit(False))
        return text.rlike(self.regex) & round_trip

    def _around(self, directive: str, literal: str | None = None) -> str:
        before, after = self.regex[2:-2].split(f"(?<{directive}>", 1)
        body, after = after.split(")", 1)
        strip = lambda part: re.sub(r"\(\?<\w+>", "(?:", part)
        return rf"\A({strip(before)}){literal or body}({strip(after)})\z"


def compile_format(kind: str, text: str) -> TemporalFormat:
    """Translate a format; unsupported directives are an error at build time."""
    expanded = re.sub(r"%([FDTR])", lambda m: _SHORTHANDS[m.group(1)], text)
    pattern, regex, parts = "", "", []
    position = 0
    while position < len(expanded):
        char = expanded[position]
        if char == "%":
            name = expanded[position + 1 : position + 2]
            position += 2
            if name == "%":
                pattern, regex = pattern + "%", regex + "%"
                continue
            if name not in _DIRECTIVES:
                raise ValueError(f"unsupported directive `%{name}` in format `{text}`")
            part, spark_pattern, piece = _DIRECTIVES[name]
            is_date = part in _DATE_PARTS
            if (kind == "date" and not is_date) or (kind == "time" and is_date):
                raise ValueError(f"directive `%{name}` does not belong in a {kind} format")
            if part in parts:
                raise ValueError(f"directive `%{name}` repeats the {part} in format `{text}`")
            parts.append(part)
            pattern += spark_pattern
            regex += f"(?<{name}>{piece})"
            continue
        pattern += "''" if char == "'" else f"'{char}'" if char.isalpha() or char in "[]{}#" else char
        regex += re.escape(char)
        position += 1
    return TemporalFormat(kind, text, pattern, rf"\A{regex}\z", frozenset(parts))
