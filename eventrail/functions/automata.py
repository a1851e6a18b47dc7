"""Regexes that cannot overflow a stack or take more than linear time, as Catalyst expressions.

Java matches a repeated group by recursion, a step for each repetition, and tries overlapping
repetitions in every way, so one long value of a stranger could end an executor. A pattern is
therefore read at build time. Only whether it matches counts, so any pattern with the same
matches will do: repeated alternatives of one character become classes, nested repetition is
flattened, and repetition at the open ends of a search is cut. What then repeats classes only is left to
Java. All else becomes a deterministic automaton over classes of code points: characters are replaced by
the number of their class, and a table is followed, still inside the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to which overlapping repetitions of classes are left to Java.
SHORT_TEXT = 512
#: Repetitions of a group that Java may nest, and the most states and classes of an automaton.
NESTED, STATES, CLASSES = 256, 4000, 200
_NODES = 20_000
#: Ranges of a class that Java tries in a row, and the entries of a table up to which it is made minimal.
_RANGES, _MINIMAL = 8, 20_000

_LIMIT = 0x110000
_TOKENS = 0xE000  # private characters that stand for classes
_ESCAPED = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_LOOKS = {"b": "word", "B": "inside", "A": "start", "z": "end"}
_HEX = re.compile(r"x\{([0-9A-Fa-f]+)\}|u\{([0-9A-Fa-f]+)\}|U\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})")
POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
#: The POSIX classes, which the dialect has for ASCII only.
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t ",
    "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
_FLAGS = re.compile(r"\(\?([imsxU]*)(?:-([imsxU]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<[A-Za-z_]\w*>")
_PROPERTY = re.compile(r"[pP](?:\{[^}]*\}|[A-Z])")


@lru_cache(1)
def _every() -> str:
    return "".join(map(chr, range(_LIMIT)))


Runs = tuple[tuple[int, int], ...]  # first and last code points, ascending and apart


@lru_cache(2048)
def members(text: str, ignore_case: bool = False, dot_all: bool = False) -> Runs:
    """The code points that the class ``text`` (or ``.``) holds."""
    flags = regex.V1 | (regex.IGNORECASE if ignore_case else 0) | (regex.DOTALL if dot_all else 0)
    return tuple((m.start(), m.end() - 1) for m in regex.finditer(f"(?:{text})+", _every(), flags))


def _array(runs: Runs) -> np.ndarray:
    out = np.zeros(_LIMIT, bool)
    for first, last in runs:
        out[first : last + 1] = True
    return out


def _runs(chars: np.ndarray) -> Runs:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], chars, [False]])))
    return tuple((int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True))


@dataclass(frozen=True)
class Node:
    """set: its members; look: its kind; cat, alt: parts; rep: a part, and how often."""

    kind: str
    parts: tuple[Node, ...] = ()
    chars: Runs = ()
    look: str = ""
    low: int = 0
    high: int | None = 0

    @property
    def endless(self) -> bool:
        return self.kind == "rep" and self.high is None


EMPTY = Node("cat")


class _Reader:
    """Reads the linear-time dialect: no look-around, no references."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.text, self.at = pattern, 0
        self.flags = {"i": ignore_case, "s": False, "m": False, "x": False}

    def fail(self, reason: str) -> ValueError:
        return ValueError(f"invalid regex `{self.text}`: {reason}")

    def read(self) -> Node:
        node = self.alternatives()
        if self.at < len(self.text):
            raise self.fail("unmatched )")
        return node

    def alternatives(self) -> Node:
        kept = dict(self.flags)
        options, parts = [], []
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                options.append(Node("cat", tuple(parts)))
                parts = []
                self.at += 1
            elif (node := self.repeated()) is not None:
                parts.append(node)
        self.flags = kept
        options.append(Node("cat", tuple(parts)))
        return options[0] if len(options) == 1 else Node("alt", tuple(options))

    def repeated(self) -> Node | None:
        node = self.single()
        while node is not None and self.at < len(self.text):
            self.spaces()
            char = self.text[self.at : self.at + 1]
            count = _COUNT.match(self.text, self.at) if char == "{" else None
            if char and char in "*+?":
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[char]
                self.at += 1
            elif count:
                low = int(count[1])
                high = (int(count[3]) if count[3] else None) if count[2] else low
                if high is not None and high < low:
                    raise self.fail("repetition out of order")
                self.at = count.end()
            else:
                break
            if self.text[self.at : self.at + 1] == "?":
                self.at += 1
            node = Node("rep", (node,), low=low, high=high)
        return node

    def spaces(self) -> None:
        while self.flags["x"] and self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text[self.at] == "#":
                self.at = (self.text.find("\n", self.at) + 1) or len(self.text)
            else:
                break

    def single(self) -> Node | None:
        self.spaces()
        if self.at >= len(self.text) or self.text[self.at] in "|)":
            return None
        char = self.text[self.at]
        if char == "(":
            return self.group()
        if char == "[":
            return self.bracket()
        if char == "\\":
            return self.escape()
        self.at += 1
        if char == ".":
            return Node("set", chars=members(".", False, self.flags["s"]))
        if char == "^":
            return Node("look", look="line" if self.flags["m"] else "start")
        if char == "$":
            return Node("look", look="line_end" if self.flags["m"] else "end")
        if char in "*+?":
            raise self.fail("nothing to repeat")
        return self.literal(char)

    def literal(self, char: str) -> Node:
        if not self.flags["i"]:
            return Node("set", chars=((ord(char), ord(char)),))
        return Node("set", chars=members(regex.escape(char), True))

    def group(self) -> Node | None:
        flags = _FLAGS.match(self.text, self.at)
        named = _NAMED.match(self.text, self.at)
        if flags:
            self.at = flags.end()
            changed = {c: True for c in flags[1]} | {c: False for c in flags[2] or ""}
            if flags[3] == ")":
                self.flags |= changed
                return None
            kept, self.flags = self.flags, self.flags | changed
            node = self.alternatives()
            self.flags = kept
        else:
            self.at = named.end() if named else self.at + 1
            node = self.alternatives()
        if self.text[self.at : self.at + 1] != ")":
            raise self.fail("unclosed group")
        self.at += 1
        return node

    def escape(self) -> Node:
        name = self.text[self.at + 1 : self.at + 2]
        code = _HEX.match(self.text, self.at + 1)
        listed = _PROPERTY.match(self.text, self.at + 1)
        if code:
            self.at = code.end()
            return self.literal(chr(int(next(g for g in code.groups() if g), 16)))
        if listed:
            self.at = listed.end()
            return Node("set", chars=members("\\" + listed[0], self.flags["i"]))
        self.at += 2
        if name in _LOOKS:
            return Node("look", look=_LOOKS[name])
        if name and name in "dDwWsS":
            return Node("set", chars=members("\\" + name))
        if name in _ESCAPED:
            return self.literal(chr(_ESCAPED[name]))
        if not name or name.isalnum():
            raise self.fail(f"unsupported escape `\\{name}`")
        return self.literal(name)

    def bracket(self) -> Node:
        """A class, with nested ones; the library's reading of its text is the dialect's own."""
        start, depth = self.at, 0
        while self.at < len(self.text):
            if self.text[self.at] == "\\":
                self.at += 1
            elif self.text.startswith("[:", self.at) and (end := self.text.find(":]", self.at)) > 0:
                self.at = end + 1
            elif self.text[self.at] == "[":
                depth += 1
                opened = re.match(r"\^?\]", self.text[self.at + 1 :])
                self.at += opened.end() if opened else 0
            elif self.text[self.at] == "]":
                depth -= 1
                if not depth:
                    break
            self.at += 1
        else:
            raise self.fail("unclosed character class")
        self.at += 1
        text = POSIX.sub(lambda m: self.posix(m), self.text[start : self.at])
        text = _HEX.sub(lambda m: f"U{int(next(g for g in m.groups() if g), 16):08X}", text) if "\\" in text else text
        try:
            return Node("set", chars=members(text, self.flags["i"]))
        except regex.error as error:
            raise self.fail(str(error)) from None


    def posix(self, found: re.Match) -> str:
        if found[2] not in POSIX_CLASSES:
            raise self.fail(f"unknown class `{found[0]}`")
        return f"[{found[1]}{POSIX_CLASSES[found[2]]}]"


def _joined(a: Runs, b: Runs) -> Runs:
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return tuple(out)


def simplified(node: Node) -> Node:
    """A pattern with the same matches: flat, one class for alternatives of one character."""
    if node.kind == "cat":
        parts: list[Node] = []
        for part in map(simplified, node.parts):
            parts += part.parts if part.kind == "cat" else [part]
        return parts[0] if len(parts) == 1 else Node("cat", tuple(parts))
    if node.kind == "alt":
        options: list[Node] = []
        for part in map(simplified, node.parts):
            for option in part.parts if part.kind == "alt" else (part,):
                if option.kind == "set" and options and options[-1].kind == "set":
                    options[-1] = Node("set", chars=_joined(options[-1].chars, option.chars))
                elif option not in options:
                    options.append(option)
        # Classes first: the order of alternatives does not change whether one matches.
        options.sort(key=lambda o: o.kind != "set")
        while len(options) > 1 and options[1].kind == "set":
            options[:2] = [Node("set", chars=_joined(options[0].chars, options[1].chars))]
        return options[0] if len(options) == 1 else Node("alt", tuple(options))
    if node.kind == "rep":
        part = simplified(node.parts[0])
        low, high = node.low, node.high
        if part == EMPTY or high == 0:
            return EMPTY
        if part.kind == "rep" and part.low <= 1 and (part.endless or part.high == 1) and low <= 1 and high is None:
            return Node("rep", part.parts, low=min(part.low, low), high=None)
        if part.kind == "rep" and part.endless and part.low <= 1 and low <= 1:
            return Node("rep", part.parts, low=min(part.low, low), high=None)
        if part.kind == "alt" and high is None and low <= 1:
            # (?:x|y+)* is (?:x|y)*: repetition of alternatives repeats each of them as well.
            inner = [o.parts[0] if o.endless and o.low == 1 else o for o in part.parts]
            if inner != list(part.parts):
                return simplified(Node("rep", (Node("alt", tuple(inner)),), low=low, high=None))
        return part if (low, high) == (1, 1) else Node("rep", (part,), low=low, high=high)
    return node


def _trimmed(node: Node) -> Node:
    """Without the repetition at the ends of a search that adds no match and takes time."""
    parts = list(node.parts) if node.kind == "cat" else [node]
    for at in (0, -1):
        while parts and parts[at].kind == "rep" and not _looks(parts[at]):
            low = parts[at].low
            if low == parts[at].high:
                break
            parts[at : at + 1 or None] = [Node("rep", parts[at].parts, low=low, high=low)] if low else []
    return simplified(Node("cat", tuple(parts)))


def _looks(node: Node) -> bool:
    return node.kind == "look" or any(map(_looks, node.parts))


def _nested(node: Node) -> int | None:
    """How deep Java may recurse over repeated groups; None: without bound."""
    inner = [_nested(p) for p in node.parts]
    if None in inner:
        return None
    most = max(inner, default=1)
    if node.kind != "rep":
        return most
    if node.parts[0].kind == "set":
        # Java steps back over these in a loop, but for bounded ones of mixed width.
        return 1 if node.endless and node.low <= 1 else None if node.endless else node.high
    return None if node.endless else most * node.high


def _endless(node: Node) -> int:
    return node.endless + sum(map(_endless, node.parts))


def _looked(node: Node) -> set[str]:
    """The kinds of looks in it."""
    return {node.look} - {""} | set().union(*map(_looked, node.parts))


def _rest(runs: Runs) -> Runs:
    """All other code points."""
    edges = [-1, *(x for run in runs for x in run), _LIMIT]
    return tuple((a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if a + 1 < b)


def _class(runs: Runs) -> str:
    """A class for Java, which tries ranges one after the other: many are halved, ASCII comes first."""
    rest = _rest(runs)
    if not runs:
        return "(?!)"
    if rest and len(rest) < len(runs) and len(rest) <= _RANGES:
        return f"[^{_ranges(rest)}]"
    low, high = [r for r in runs if r[0] < 128], [r for r in runs if r[0] >= 128]
    return f"[{_ranges(low)}{_ranges(high)}]"


def _ranges(runs: list[tuple[int, int]] | Runs) -> str:
    if len(runs) <= _RANGES:
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    half = len(runs) // 2
    parts = (runs[:half], runs[half:])
    return "".join(f"[[\\x{{{p[0][0]:x}}}-\\x{{{p[-1][1]:x}}}]&&[{_ranges(p)}]]" for p in parts)


_JAVA_LOOKS = {
    "word": "(?U:\\b)", "inside": "(?U:\\B)", "start": "\\A", "end": "\\z", "line": "(?md:^)", "line_end": "(?md:$)",
}


def _java(node: Node) -> str:
    if node.kind == "set":
        return _class(node.chars)
    if node.kind == "look":
        return _JAVA_LOOKS[node.look]
    if node.kind == "alt":
        return "(?:" + "|".join(map(_java, node.parts)) + ")"
    if node.kind == "cat":
        return "".join(map(_java, node.parts))
    part = _java(node.parts[0])
    if node.parts[0].kind != "set":
        part = f"(?:{part})"
    if node.high is None:
        return part + ("*" if node.low == 0 else "+")
    return f"{part}{{{node.low},{node.high}}}"


@dataclass
class _States:
    """Places of an automaton: per place, moves (class, to), and free moves (look or None, to)."""

    moves: list[list[tuple[int, int]]] = field(default_factory=list)
    free: list[list[tuple[str | None, int]]] = field(default_factory=list)

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        if len(self.moves) > _NODES:
            raise ValueError("the regex is too large")
        return len(self.moves) - 1


class Automaton:
    """The deterministic automaton of a search: classes of code points, table, accepting states."""

    def __init__(self, node: Node) -> None:
        sets: dict[Runs, int] = {}

        def collect(part: Node) -> None:
            if part.kind == "set":
                sets.setdefault(part.chars, len(sets))
            for inner in part.parts:
                collect(inner)

        collect(node)
        # Code points that no set and no look tells apart are one class.
        looks = _looked(node)
        words, lines = bool(looks & {"word", "inside"}), bool(looks & {"line", "line_end"})
        told = [*sets, *([members(r"\w")] if words else []), *([members("\n")] if lines else [])]
        rows = np.array([_array(s) for s in told], bool).reshape(-1, _LIMIT)
        packed = np.zeros((_LIMIT, -(-max(len(told), 1) // 8)), np.uint8)
        if len(told):
            packed = np.packbits(rows, axis=0).T
        kinds, first, self.of = np.unique(
            np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True
        )
        self.classes = len(kinds)
        if self.classes > CLASSES:
            raise ValueError("the regex tells too many classes of characters apart")
        self.within = [set(np.flatnonzero(row[first]).tolist()) for row in rows[: len(sets)]]
        wordlike = set(np.flatnonzero(rows[len(sets)][first]).tolist()) if words else set()
        newline = set(np.flatnonzero(rows[-1][first]).tolist()) if lines else set()
        #: What a look sees of a character: a letter of a word, a line feed, anything else.
        self.seen = ["word" if c in wordlike else "line" if c in newline else "other" for c in range(self.classes)]
        self.sets, self.states = sets, _States()
        self.first = self.states.new()
        self.last = self._place(node, self.first)
        self._determine()
        self._reduce()

    def _place(self, node: Node, at: int) -> int:
        states = self.states
        if node.kind == "set":
            to = states.new()
            states.moves[at] += [(c, to) for c in self.within[self.sets[node.chars]]]
            return to
        if node.kind == "look":
            to = states.new()
            states.free[at].append((node.look, to))
            return to
        if node.kind == "cat":
            for part in node.parts:
                at = self._place(part, at)
            return at
        to = states.new()
        if node.kind == "alt":
            for part in node.parts:
                begin = states.new()
                states.free[at].append((None, begin))
                states.free[self._place(part, begin)].append((None, to))
            return to
        for _ in range(node.low):
            at = self._place(node.parts[0], at)
        states.free[at].append((None, to))
        if node.high is None:
            begin = states.new()
            states.free[at].append((None, begin))
            states.free[self._place(node.parts[0], begin)].append((None, begin))
            states.free[begin].append((None, to))
        else:
            for _ in range(node.high - node.low):
                at = self._place(node.parts[0], at)
                states.free[at].append((None, to))
        return to

    def _reached(self, places: frozenset[int], before: str, after: str) -> set[int]:
        """Places reached by free moves between a character and the next (start and end: none)."""
        holds = {
            None: True,
            "start": before == "start",
            "end": after == "end",
            "line": before in ("start", "line"),
            "line_end": after in ("end", "line"),
            "word": (before == "word") != (after == "word"),
            "inside": (before == "word") == (after == "word"),
        }
        out, todo = set(places), list(places)
        while todo:
            for look, to in self.states.free[todo.pop()]:
                if holds[look] and to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def _determine(self) -> None:
        start = (frozenset([self.first]), "start")
        number, order = {start: 0}, [start]
        found = ("found",)
        table, accepting = [], []
        for state in order:
            if state == found:
                table.append([number[state]] * self.classes)
                accepting.append(True)
                continue
            places, before = state
            accepting.append(self.last in self._reached(places, before, "end"))
            row = []
            closed: dict[str, set[int]] = {}
            for c in range(self.classes):
                seen = self.seen[c]
                if seen not in closed:
                    closed[seen] = self._reached(places, before, seen)
                if self.last in closed[seen]:
                    to = found
                else:
                    after = {p for at in closed[seen] for k, p in self.states.moves[at] if k == c}
                    to = (frozenset(after | {self.first}), seen)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                    if len(order) > STATES:
                        raise ValueError("the regex needs too many states")
                row.append(number[to])
            table.append(row)
        self.table, self.accepting = table, accepting

    def _reduce(self) -> None:
        """One state for all with the same future, and one class for all that move alike."""
        table, block = np.array(self.table, np.int64), np.array(self.accepting, np.int64)
        if table.size <= _MINIMAL:
            kinds = 0
            while kinds < (kinds := len(set(block.tolist()))):
                _, block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
                block = block.ravel()
            # The first state stays the first.
            _, members, order = np.unique(block, return_index=True, return_inverse=True)
            place = np.argsort(np.argsort(members))
            block = place[order.ravel()]
            members = np.sort(members)
            table = block[table[members]]
            self.accepting = [self.accepting[m] for m in members]
        moves, kept = np.unique(table, axis=1, return_inverse=True)
        self.of = kept.ravel()[self.of.ravel()]
        self.table, self.classes = moves.tolist(), moves.shape[1]
        #: Classes of which a run moves as one character does.
        self.runs = [bool((m[m] == m).all()) for m in moves.T]

    def matches(self, text: str) -> bool:
        state = 0
        for char in text:
            state = self.table[state][self.of[ord(char)]]
        return self.accepting[state]

    def column(self, text: Column) -> Column:
        """Whether the pattern is found in the text, by following the table."""
        if len(set(self.accepting)) == 1:
            return F.when(text.isNotNull(), F.lit(self.accepting[0]))
        n = self.classes
        tokens = [chr(_TOKENS + c) for c in range(n)]
        own = int(self.of[_TOKENS])
        block = self.of[_TOKENS : _TOKENS + n]
        if (block != own).any():
            raise ValueError("the regex names private characters")
        spare = next(c for c in range(_TOKENS + n, _LIMIT) if self.of[c] == own)
        # Private characters of the text itself first become another one of their class.
        coded = F.regexp_replace(text, f"[{tokens[0]}-{tokens[-1]}]", chr(spare))
        spelled = []
        for c in range(n):
            inside = self.of == c
            inside[_TOKENS : _TOKENS + n] = False
            spelled.append((_runs(inside), c))
        # Few ranges first; the last class is all that is no token yet. Runs shrink where one will do.
        for at, (inside, c) in enumerate(sorted(spelled, key=lambda s: len(s[0])), 1):
            listed = _class(inside) if at < n else f"[^{tokens[0]}-{tokens[-1]}]"
            coded = F.regexp_replace(coded, listed + "+" * self.runs[c], tokens[c])
        flat = ",".join(str(to * n) for row in self.table for to in row)
        table = F.split(F.lit(flat), ",").cast("array<int>")
        end = F.aggregate(
            F.split(coded, ""),
            F.lit(0),
            lambda at, c: F.when(c == "", at).otherwise(F.element_at(table, at + F.ascii(c) - (_TOKENS - 1))),
        )
        good = [n * s for s, yes in enumerate(self.accepting) if yes]
        return end.isin(good) if good else F.when(end.isNotNull(), F.lit(False))


@dataclass(frozen=True)
class Search:
    """How a pattern is searched for: by Java (its regex), by an automaton, or by length of the text."""

    java: str | None
    automaton: Automaton | None

    def column(self, text: Column) -> Column:
        if self.automaton is None:
            return text.rlike(self.java)
        followed = self.automaton.column(text)
        if self.java is None:
            return followed
        return F.when(F.char_length(text) <= SHORT_TEXT, text.rlike(self.java)).otherwise(followed)


def search(pattern: str, ignore_case: bool, java: str) -> Search:
    """The safe search for a pattern, whose spelling for Java is ``java``.

    A pattern that neither Java nor an automaton of bounded size can follow is refused.
    """
    read = _Reader(pattern, ignore_case).read()
    plain = simplified(read)
    cut = _trimmed(plain)
    depth = _nested(cut)
    safe = depth is not None and depth <= NESTED
    if safe and _endless(cut) <= 1:
        return Search(java if cut == plain and _nested(read) is not None else _java(cut), None)
    try:
        automaton = Automaton(cut)
    except ValueError as error:
        raise ValueError(f"invalid regex `{pattern}`: {error}") from None
    return Search(_java(cut) if safe else None, automaton)
