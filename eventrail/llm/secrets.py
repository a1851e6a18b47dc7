"""Secret scans through a trigram inverted index.

Each rule's pattern is turned into a Boolean trigram query. Postings (trigram, row) of the
trigrams that the rules ask for are intersected to find candidate rows, and only candidates
are verified with the pattern itself. A rule without mandatory trigrams scans every row.
Texts are looked at by DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import staged, table

#: A clause is a set of alternatives, of which one must hold; an alternative is a set of
#: trigrams, all of which must occur. All clauses of a query must hold.
Clause = frozenset[frozenset[str]]

_STRINGS = 16  # literal strings followed at once when a pattern is read
#: Candidate rows that may be broadcast; more are joined by a shuffle. About 64 bytes each.
BROADCAST_ROWS = 500_000
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # in the syntax that Java and Python share
    group: int = 0  # the group whose length counts
    least: int = 1  # characters of that group; shorter matches are dropped
    probe: str = ""  # found in every text with a match that is kept; cheaper to look for


#: The patterns and lengths of the base kinds, in the order of their listing.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _read(tokens) -> tuple[set[str] | None, list[Clause]]:
    """The strings that the sequence can match, if they are few, and its mandatory clauses."""
    exact: set[str] | None = {""}
    run, clauses = {""}, []

    def close() -> None:
        nonlocal run
        if all(len(s) > 2 for s in run):
            clauses.append(frozenset(_grams(s) for s in run))
        run = {""}

    for op, value in tokens:
        strings, inner = _strings(str(op), value)
        joined = {a + b for a, b in product(run, strings)} if strings else None
        if joined and len(joined) <= _STRINGS:
            run = joined
        else:
            close()
            run = set(strings) if strings and len(strings) <= _STRINGS else {""}
            clauses += inner
            exact = None
        if exact is not None:
            exact = set(run)
    close()
    return exact, clauses


def _strings(op: str, value) -> tuple[set[str] | None, list[Clause]]:
    """What one element of a pattern matches."""
    if op == "LITERAL":
        return {chr(value).lower()}, []
    if op == "SUBPATTERN":
        return _read(value[-1])
    if op == "IN":
        letters = {chr(v).lower() for kind, v in value if str(kind) == "LITERAL"}
        return (letters, []) if all(str(kind) == "LITERAL" for kind, _ in value) else (None, [])
    if op == "BRANCH":
        read = [_read(part) for part in value[1]]
        if all(strings for strings, _ in read):
            return set().union(*(strings for strings, _ in read)), []
        firsts = [clauses[0] for _, clauses in read if clauses]
        return None, [frozenset().union(*firsts)] if len(firsts) == len(read) else []
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, part = value
        strings, clauses = _read(part)
        if (low, high) == (0, 1) and strings:
            return {"", *strings}, []
        if low == high == 1:
            return strings, clauses
        if low and strings and all(len(s) > 2 for s in strings):
            return None, [frozenset(_grams(s) for s in strings)]
        return None, clauses if low else []
    return None, []


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses of lower-case trigrams that every match implies; none: scan every row."""
    return list(dict.fromkeys(_read(parser.parse(pattern))[1]))


def build_index(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id") -> DataFrame:
    """Postings (gram, key): which rows hold which of the trigrams that the rules ask for."""
    wanted = sorted({g for r in rules for c in trigram_query(r.pattern) for a in c for g in a})
    if not wanted:
        return docs.select(F.lit("").alias("gram"), key).limit(0)
    listed = F.array(*map(F.lit, wanted))
    # The one-element array binds the lower-cased text, so that it is made once.
    found = F.transform(
        F.array(F.lower("text")), lambda low: F.filter(listed, lambda gram: F.contains(low, gram))
    )[0]
    return docs.select(key, F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id") -> DataFrame:
    """(key, rules): the indexed rules whose trigram query the row's postings satisfy."""
    asked, counts = [], {}
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        counts[rule.name] = len(clauses)
        for c, clause in enumerate(clauses):
            for a, grams in enumerate(sorted(clause, key=sorted)):
                asked += [(gram, rule.name, c, a, len(grams)) for gram in sorted(grams)]
    spark = index.sparkSession
    query = spark.createDataFrame(asked, "gram string, rule string, clause int, option int, need int")
    needed = spark.createDataFrame(list(counts.items()), "rule string, clauses int")
    met = (
        index.join(F.broadcast(query), "gram")  # as small as the rules
        .groupBy(key, "rule", "clause", "option", "need")
        .agg(F.count_distinct("gram").alias("held"))
        .where("held = need")
    )
    full = met.groupBy(key, "rule").agg(F.count_distinct("clause").alias("held"))
    passed = full.join(F.broadcast(needed), "rule").where("held = clauses")
    return passed.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one. In blocks, as growing an array copies it."""
    block = 256

    def grow(values: Column, start: Column) -> Column:
        sums = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(values))

    zero = F.lit(0).cast("long")
    cuts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(block)).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, F.lit(block)),
    )
    bound = F.transform(
        F.array(cuts),
        lambda blocks: F.zip_with(
            blocks,
            grow(F.transform(blocks, lambda v: F.aggregate(v, zero, lambda a, x: a + x)), zero),
            grow,
        ),
    )[0]
    return F.flatten(bound)


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind, name, end) of the leftmost non-overlapping matches that are long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    counted = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m).cast("long")
    )
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
    zipped = F.transform(
        F.array(F.struct(whole.alias("whole"), counted.alias("counted"), gaps.alias("gaps"))),
        lambda r: F.transform(
            F.zip_with(
                F.zip_with(r["whole"], r["counted"], lambda m, c: F.struct(m.alias("whole"), c.alias("counted"))),
                F.zip_with(
                    F.slice(r["gaps"], 1, F.size(r["whole"])),
                    _running(F.zip_with(r["whole"], F.slice(r["gaps"], 1, F.size(r["whole"])), lambda m, g: m + g)),
                    lambda gap, before: gap + before,
                ),
                lambda m, start: F.struct(m["whole"].alias("whole"), m["counted"].alias("counted"), start.alias("start")),
            ),
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(number).alias("kind"),
                F.lit(rule.name).alias("name"),
                (m["start"] + m["whole"]).alias("end"),
                m["counted"].alias("counted"),
            ),
        ),
    )[0]
    kept = F.filter(zipped, lambda m: m["counted"] >= rule.least)
    return F.transform(kept, lambda m: F.struct(m["start"], m["kind"], m["name"], m["end"]))


SPANS = "array<struct<start:bigint,kind:int,name:string,end:bigint>>"


def _found(text: Column, rule: Rule, number: int, chosen: Column) -> Column:
    """Spans of one rule; rows that are no candidates are not looked at."""
    none = F.array().cast(SPANS)
    return F.when(chosen, _matches(text, rule, number).cast(SPANS)).otherwise(none)


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, key: str = "doc_id", label: str = "secrets"
) -> DataFrame:
    """``docs`` with ``spans``: (start, kind, name, end) in code points, by start, then kind.

    A null text has no spans. Keys may repeat or be null: rows of one key are candidates
    together, and each is verified by its own text. Existing columns named ``spans`` are
    replaced; all other columns pass unchanged.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    chosen = candidates(build_index(docs, indexed, key), indexed, key) if indexed else None
    joined = docs.withColumn("__rules", F.array().cast("array<string>"))
    if chosen is not None:
        chosen = staged(chosen.select(F.col(key).alias("__key"), F.col("rules").alias("__rules")), label)
        small = chosen.count() <= BROADCAST_ROWS
        side = F.broadcast(chosen) if small else chosen
        joined = docs.join(side, docs[key].eqNullSafe(side["__key"]), "left").drop("__key")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for number, rule in enumerate(rules):
        if rule in indexed:
            candidate = F.coalesce(F.array_contains("__rules", rule.name), F.lit(False))
        else:
            candidate = text.rlike(rule.probe or rule.pattern)
        found.append(_found(text, rule, number, candidate))
    return joined.withColumn("spans", F.array_sort(F.concat(*found))).drop("__rules")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mask in place of every run of characters that spans cover."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], gap, F.lit(MASK))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, rest)).otherwise(text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [r.name for r in BASE]
    found = scan(docs)
    count = lambda name: F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[count(name).alias(f"n_{name}") for name in base],
        F.sha2(listed(F.filter("spans", lambda s: s["name"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """Matches and the gaps between them, by list functions; starts are sums of lengths."""
    fixed = (
        ("assign", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
         "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", "(AKIA[A-Z0-9]+)", 1, 20),
        ("hex", "([0-9a-f]+)", 1, 24),
        ("pem", "(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----)", 1, 1),
        ("forge", "(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    )
    parts = []
    for number, (name, pattern, group, least) in enumerate(fixed):
        parts.append(
            f"SELECT doc_id, '{name}' AS name, {number} AS kind, s AS start, s + len(m[i]) AS stop FROM ("
            f" SELECT doc_id, m, g, i, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0)"
            f" + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS s FROM ("
            f" SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,"
            f" regexp_split_to_array(t, '{pattern}') AS gaps, unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i"
            f" FROM d WHERE regexp_matches(t, '{pattern.replace('[0-9a-f]+', '[0-9a-f]{24,}')}'))) WHERE len(g[i]) >= {least}"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + ")"
        ", s AS (SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access,"
        " count(*) FILTER (name = 'hex') AS n_hex,"
        " string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,"
        " string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS every FROM f GROUP BY doc_id)"
        " SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,"
        " sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN s USING (doc_id)"
    )


ORACLE_SQL = _oracle()
