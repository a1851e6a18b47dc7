"""Linear-time regex syntax expressed in Java's regex dialect."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

from eventrail.functions.automata import POSIX, POSIX_CLASSES, Search, search

_GROUP = re.compile(r"\(\?(P?<[A-Za-z_]\w*>|[imsx-]*[:)])")
_PROPERTY = re.compile(r"\\[pP](?:\{(\^?)([^}]*)\}|([A-Z]))")
_ESCAPES = set("dDwWsSbBAzntrfv0123456789pPxuU")


def searched(pattern: str, ignore_case: bool = False) -> Search:
    """How to look for the pattern in time linear in the text, and on a bounded stack."""
    return search(pattern, ignore_case, to_java(pattern, ignore_case))


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Java pattern with the same matches: Unicode classes, ``$`` only at the very end.

    Look-around, back-references and possessive quantifiers do not exist in the
    source dialect and are refused.
    """
    multi_line = pattern.startswith("(?m)")
    if not multi_line and re.search(r"\(\?[isx]*m", pattern):
        raise ValueError(f"multi-line mode must cover the whole regex `{pattern}`")
    out, position, in_class = [], 0, 0
    while position < len(pattern):
        char = pattern[position]
        if char == "\\":
            name = pattern[position + 1 : position + 2]
            if name in ("p", "P"):
                text, position = _property(pattern, position)
                out.append(text)
                continue
            if name == "" or (name.isalnum() and name not in _ESCAPES):
                raise ValueError(f"unsupported escape `\\{name}` in regex `{pattern}`")
            if name.isdigit():
                raise ValueError(f"back-references are not supported: `{pattern}`")
            braced = name in "uU" and pattern[position + 2 : position + 3] == "{"
            out.append("\\x" if braced else char + name)
            position += 2
            continue
        if in_class:
            posix = POSIX.match(pattern, position)
            if posix:
                if posix.group(2) not in POSIX_CLASSES:
                    raise ValueError(f"unknown class `{posix.group(0)}` in regex `{pattern}`")
                out.append(f"[{posix.group(1)}{POSIX_CLASSES[posix.group(2)]}]")
                position = posix.end()
                continue
            if pattern.startswith(("--", "~~"), position):
                raise ValueError(f"unsupported class operation in regex `{pattern}`")
            in_class += (char == "[") - (char == "]")
            out.append(char)
        elif char == "[":
            in_class = 1
            out.append(char)
            following = re.match(r"\^?\]", pattern[position + 1 :])
            if following:
                out.append(following.group(0).replace("]", "\\]"))
                position += following.end()
        elif char == "(" and pattern.startswith("(?", position):
            group = _GROUP.match(pattern, position)
            if not group:
                raise ValueError(f"look-around is not supported: `{pattern}`")
            out.append(group.group(0).replace("(?P<", "(?<"))
            position = group.end()
            continue
        elif char == "$":
            out.append("$" if multi_line else "\\z")
        elif char == "+" and _after_quantifier(pattern, position) and not _ends_escape(pattern, position):
            raise ValueError(f"possessive quantifiers are not supported: `{pattern}`")
        else:
            out.append(char)
        position += 1
    if in_class:
        raise ValueError(f"unclosed character class in regex `{pattern}`")
    return _compiled(("(?Udi)" if ignore_case else "(?Ud)") + "".join(out), pattern)


def _property(pattern: str, position: int) -> tuple[str, int]:
    """A Unicode property in Java's spelling: categories as they are, scripts as ``IsGreek``."""
    found = _PROPERTY.match(pattern, position)
    if not found:
        raise ValueError(f"incomplete property in regex `{pattern}`")
    negated, name, letter = found.groups()
    sign = "P" if (pattern[position + 1] == "P") != bool(negated) else "p"
    name = letter or name
    label, _, value = name.partition("=")
    if value:
        name = value if label.lower() in ("gc", "general_category") else f"Is{value}"
    elif not re.fullmatch("[A-Z][a-z]?|L&", name):
        name = f"Is{name}"
    return f"\\{sign}{{{name}}}", found.end()


def _ends_escape(pattern: str, position: int) -> bool:
    """Whether the brace before ``position`` closes an escape such as ``\\p{Greek}``."""
    return bool(re.search(r"\\[pPxuU]\{[^{}]*\}$", pattern[:position]))


def _compiled(java: str, pattern: str) -> str:
    """The pattern, once Java accepts it; without a running session tasks find out."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except IllegalArgumentException as refused:
            reason = str(refused).splitlines()[0]
            raise ValueError(f"invalid regex `{pattern}`: {reason}") from None
    return java


def _after_quantifier(pattern: str, position: int) -> bool:
    before = pattern[:position]
    if before[-1:] not in ("*", "+", "?", "}"):
        return False
    slashes = len(before[:-1]) - len(before[:-1].rstrip("\\"))
    return slashes % 2 == 0

