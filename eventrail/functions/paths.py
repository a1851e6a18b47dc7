"""Dotted field paths as VARIANT paths.

A segment only ever names an object key, so every segment is quoted: ``a.0``
looks up the key ``"0"`` and never an array position.
"""

from __future__ import annotations


def _quoted(segment: str) -> str:
    if '"' not in segment:
        return f'["{segment}"]'
    if "'" not in segment:
        return f"['{segment}']"
    raise ValueError(f"path segment with both kinds of quotes: {segment!r}")


def field_path(path: str) -> str:
    """Path of a validation field; an empty segment is the key ``""``."""
    return "$" + "".join(_quoted(part) for part in path.split("."))


def column_path(path: str) -> str | None:
    """Path of a projected column: ``$`` is the event, an empty segment is missing."""
    if path == "$":
        return "$"
    parts = path.split(".")
    if any(part == "" for part in parts):
        return None
    return "$" + "".join(_quoted(part) for part in parts)
