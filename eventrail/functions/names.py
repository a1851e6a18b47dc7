"""Names, ids and durations of the configuration."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SINK_ID_RULE = "sink_id must match [A-Za-z0-9_.-]+"


def sink_constant(sink_id: Column) -> Column:
    """Script constant of a sink id: runs of other characters become ``_``."""
    upper = F.translate(sink_id, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    joined = F.concat(F.lit("SINK_"), F.regexp_replace(upper, "[^A-Z0-9]+", "_"))
    return F.regexp_replace(joined, r"_+\z", "")


def sink_constant_name(sink_id: str) -> str:
    """The same rule for one id on the driver."""
    upper = "".join(c.upper() if c.isascii() else c for c in sink_id)
    return ("SINK_" + re.sub("[^A-Z0-9]+", "_", upper)).rstrip("_")


def project_key(name: Column) -> Column:
    """URL key of a project name; NULL when nothing is left.

    A run of other characters becomes one ``-``, also next to a dash of the name.
    """
    trimmed = F.regexp_replace(name, r"(?U)\A\s+|\s+\z", "")
    dashed = F.regexp_replace(trimmed, "[^A-Za-z0-9_-]+", "-")
    return F.nullif(F.regexp_replace(dashed, r"\A-+|-+\z", ""), F.lit(""))


def is_plain_id(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9_.-]+\z")


def check_plain_id(value: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", value):
        raise ValueError(SINK_ID_RULE)


def sink_constants(sinks: Iterable[str]) -> dict[str, str]:
    """Constant -> sink id; ids without letters or with clashing constants are refused."""
    constants: dict[str, str] = {}
    for sink in sinks:
        name = sink_constant_name(sink)
        if name == "SINK":
            raise ValueError(f"invalid event sink id '{sink}' for a constant")
        if name in constants:
            raise ValueError(
                f"event sink ids '{constants[name]}' and '{sink}' both map to constant `{name}`"
            )
        constants[name] = sink
    return constants


def check_targets(processor: str, targets: Iterable[str], sinks: Iterable[str]) -> None:
    known = set(sink_constants(sinks).values())
    for target in targets:
        if target.strip() and target not in known:
            raise ValueError(f"processor `{processor}`: unknown sink target `{target}`")


# Duration units in seconds.
_UNITS = {
    "ns": 1e-9, "us": 1e-6, "ms": 1e-3,
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
}


def duration_seconds(text: str) -> float:
    """Seconds of a duration such as ``5s``, ``1m`` or ``1h 30m``."""
    pieces = re.findall(r"(\d+)\s*([a-z]+)", text)
    if not pieces or re.sub(r"(\d+)\s*([a-z]+)|\s", "", text):
        raise ValueError(f"invalid duration: {text!r}")
    total = 0.0
    for amount, unit in pieces:
        if unit not in _UNITS:
            raise ValueError(f"unknown duration unit `{unit}` in {text!r}")
        total += int(amount) * _UNITS[unit]
    return total


def trigger_interval(text: str) -> str:
    """A duration as the interval of a streaming trigger."""
    return f"{round(duration_seconds(text) * 1000)} milliseconds"
