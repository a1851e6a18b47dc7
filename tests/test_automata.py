"""Safe searches for regexes: against another engine, on texts of every shape, and on very long ones."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from eventrail.functions import automata
from eventrail.functions.regexes import searched

PATTERNS = [
    r"^(x|y)+$", r"(a|aa)+$", r"^(a+)+b", r"^((a*)*|b)*c$", r"\bfoo\b", r"\B-\B", r"^\w+@\w+\.\w+$", r"(?i)k+s|ſ",
    r"(?m)^ab$", r"[^a-c]+d{2,3}", r"^(?:foo|bar|baz)*$", r"^(?:foo|bar){2,}$", r"a.c", r"(?s)^a.+c$", "", "x*", "^$",
    r"(ab?c|d){2,4}$", r"\p{Lu}\p{Ll}+", r"^(\d{3}-)?\d{4}$", r"a{3,}b", r"((a|b)*c|d)+e", r"(?x) a  b # c",
    r"^[\x61-\x63\u{64}]+$", r"^(?:(?i:A)|b)+$", r"[a-c&&[^b]]x", r"^(?:a|b|ab)*?ba$", r"(?:)*a", r"[]x]+$", r"^.*,.*,.*$",
    r"(?:ab){0,300}c", r"(?P<n>\w)+-", r"^(?:[^ ]+ ){2,3}[^ ]+$", r"\.|\\", r"(?:a$|^b)+",
]
PIECES = ["a", "aa", "b", "c", "x", "y", "foo", "bar", "@", "w.", "12", "345-", "\n", "ab", "d", "F", "É", "ß", " ",
          "K", "K", ",", "]", "", "\U0001f600", "-", "\\"]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 7))) for _ in range(400)]


def wanted(pattern, text):
    # The other engine lets $ match before a last line feed.
    spelled = pattern if pattern.startswith("(?m)") else pattern.replace("$", r"\Z")
    return bool(regex.search(spelled.replace(r"\u{64}", "d"), text, regex.V1))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_automaton_agrees(pattern):
    node = automata._trimmed(automata.simplified(automata._Reader(pattern, False).read()))
    automaton = automata.Automaton(node)
    for text in texts(pattern):
        assert automaton.matches(text) == wanted(pattern, text), ascii(text)


def test_columns_agree(spark):
    """What Java and the table are given, for every pattern in one plan, with null and long texts."""
    rows = [(t,) for t in texts(0)[:120]] + [(t * 200,) for t in texts(1)[:30]] + [(None,)]
    df = spark.createDataFrame(rows, "s string").coalesce(1)
    columns = []
    for n, pattern in enumerate(PATTERNS):
        found = searched(pattern)
        columns.append(found.column(F.col("s")).alias(f"p{n}"))
        if found.automaton is not None:
            columns.append(found.automaton.column(F.col("s")).alias(f"a{n}"))
    for at in range(0, len(columns), 12):
        for row in df.select("s", *columns[at : at + 12]).collect():
            for name, value in row.asDict().items():
                if name != "s":
                    want = None if row["s"] is None else wanted(PATTERNS[int(name[1:])], row["s"])
                    assert value == want, (PATTERNS[int(name[1:])], name, ascii(row["s"]))


LONG = {
    r"^(x|y)+$": ("xy" * 500_000, True),
    r"^(?:x|yy)+$": ("xyy" * 330_000, True),
    r"^(\w+\s?)*$": ("word " * 200_000 + "!", False),
    r"^(a|aa)+$": ("a" * 1_000_000 + "b", False),
    r"[a-z]+@": ("a" * 1_000_000, False),
    r"\d+\d+\d+x": ("1" * 1_000_000, False),
    r"^(?:.*,)+end$": ("field,\U0001f600," * 120_000 + "end", True),
    r"(?:ab){300}c": ("ab" * 500_000, False),
    r"(?i)^(?:straße|K)+$": ("STRASSEkK" * 100_000, False),
}


def test_long_texts_neither_overflow_nor_take_long(spark):
    for pattern, (text, want) in LONG.items():
        started = time.perf_counter()
        df = spark.createDataFrame([(text,)], "s string")
        assert df.select(searched(pattern).column(F.col("s")).alias("found")).first()["found"] is want, pattern
        assert time.perf_counter() - started < 30, pattern


def test_what_is_left_to_java():
    for pattern in (r"^(x|y)+$", r"^(a+)+b", r"(\w)+-", r"^\d+$", r"(foo|bar)", r"a{2}(b|cd)?"):
        assert searched(pattern).automaton is None, pattern
    assert searched(r"^\w+@\w+$").java and searched(r"^\w+@\w+$").automaton
    assert searched(r"^(?:ab|c)*$").java is None


@pytest.mark.parametrize("pattern", [r"^(?:[ab]*a[ab]{13}|cc)*$", r"(?:\w{200}\d){200}", "(a", "a)", "*a", "[a"])
def test_unbounded_or_broken_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        searched(pattern)


def test_classes_of_many_ranges_hold_the_same_characters(spark):
    """Halved and negated spellings of a class, against its members, over all code points."""
    blocks = ["".join(chr(c) for c in range(n, n + 4096) if not 0xD800 <= c < 0xE000) for n in range(0, 0x110000, 4096)]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(blocks)], "n int, s string").coalesce(1)
    for text in (r"\pL", r"\p{Lu}", r"\w", r"[^\pL]", r"[^ ]", r"(?s:.)"):
        runs = automata.members(text)
        spelled = automata._class(runs)
        found = df.select("n", F.regexp_replace("s", spelled, "").alias("left")).collect()
        held = {c for a, b in runs for c in range(a, b + 1)}
        for row in found:
            assert row["left"] == "".join(c for c in blocks[row["n"]] if ord(c) not in held), text


def test_only_what_a_pattern_tells_apart_is_coded():
    def coded(pattern):
        return automata.Automaton(automata._trimmed(automata.simplified(automata._Reader(pattern, False).read())))

    # Words and line feeds count where a look asks for them, and states and classes are the fewest.
    assert coded(r"^(?:.*\n)+.*$").classes == 2
    assert coded(r"^(?:[^ ]+ ){5,9}[^ ]+$").classes == 2
    assert coded(r"^(?:[\pL'-]+[ .,;:!?\n]*|[^\pL])*$").classes == 1
    assert coded(r"(a|aa)+(e|ee)+[rst]+[ ,]").runs == [True] * 5
    assert not all(coded(r"^(?:ab|c)*$").runs)


def test_letters_of_a_megabyte_take_no_minutes(spark):
    text = "Straße, один two\n" * 60_000
    df = spark.createDataFrame([(text,)], "s string")
    for pattern in (r"^(?:[^ ]+ )+[^ ]+$", r"(?:\p{Lu}\p{Ll}+ )+\p{Ll}+\."):
        started = time.perf_counter()
        assert df.select(searched(pattern).column(F.col("s")).alias("found")).first()["found"] is wanted(pattern, text)
        assert time.perf_counter() - started < 5, pattern
