"""Near-duplicates by verified similarity of word shingles.

Sets that are alone by a first look at a third of their shingles never get far. The others meet in
groups by their rarest shingles, of which similar sets must share one. In a group, sketches of the
sets rule out what cannot be similar: bits that count members, modulo 2, differ in no more places
than the sets have members apart. What sketches let through is compared in full, in two rounds. The
first takes one candidate for each member, also among documents whose SimHash fingerprints the
BK-trees link, so that a group of near copies becomes one component. The second takes every candidate
that lies in two components, from the groups that still have more than one.
Nothing is left to chance but equal 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventrail.llm import simhash
from eventrail.llm.common import components, discard, release, ships_with_tasks, staged, whole_groups
from eventrail.llm.simhash import fingerprint

ships_with_tasks(__name__)

WORDS = 5
SEED = 42
#: Sets that one task compares with one set, and members of a group among which one looks for candidates.
BLOCK = 64
CELL = 512
#: Bits of a sketch.
BITS = 1024
#: Rows that a reader decodes at once: sets and texts of thousands of rows would be one huge array each.
READ_ROWS = 256
PAIRS = "pivot long, cls long"
#: Pairs that a task gathers before it passes them on.
HELD = 1 << 20


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct word shingles; a shorter text is one, none without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    parts = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.fromiter((digest(b" ".join(p), seed) for p in parts), np.uint64).view(np.int64))


def _identity(found: np.ndarray) -> int:
    """A number for the set, as a signed one."""
    digest = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def _first(n: int) -> int:
    """How many members, in one order for all sets, similar sets must share a twentieth of n among."""
    return n - (4 * n + 4) // 5 + max(1, n // 20) if n else 0


def _members(sets: DataFrame) -> DataFrame:
    """(cls, h): members of ``sets(cls, data)``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                flat = np.frombuffer(b"".join(part["data"]), np.int64)
                many = part["data"].str.len() // 8
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(np.int64), many), "h": flat})

    return sets.select("cls", "data").mapInPandas(unpack, "cls long, h long")


def _compared(pairs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(pivot, cls, near) of ``pairs(pivot, cls)``; the pivot's set comes first in its cell."""
    cells = F.ceil(F.count("*") / F.lit(block)).cast("int")
    sizes = pairs.groupBy("pivot").agg(cells.alias("cells"))
    asked = pairs.join(sizes, "pivot").select(
        "pivot", F.pmod(F.xxhash64("cls"), F.col("cells")).cast("int").alias("salt"), F.lit(False).alias("first"), "cls"
    )
    held = sizes.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("salt"), F.lit(True).alias("first"),
        F.col("pivot").alias("cls"),
    )
    rows = held.unionByName(asked).join(sets.select("cls", "data"), "cls")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for row in batch.itertuples():
                other = np.frombuffer(row.data, np.int64)
                if row.first:
                    pivot = other
                    continue
                both = len(np.intersect1d(pivot, other, assume_unique=True))
                out.append((row.pivot, row.cls, 5 * both >= 4 * (len(pivot) + len(other) - both)))
            yield pd.DataFrame(out, columns=["pivot", "cls", "near"])

    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("first"))
    return dealt.mapInPandas(compare, f"{PAIRS}, near boolean")


def _sketch(found: np.ndarray) -> bytes:
    """For each of ``BITS`` bits, whether the set has an odd number of members there."""
    return np.packbits((np.bincount(found & (BITS - 1), minlength=BITS) & 1).astype(bool)).tobytes()


def _may_link(n: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False where rows x and y are too far apart: nine times what they differ in exceeds both sizes."""
    fits = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
    at = np.flatnonzero(fits)
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        apart = np.bitwise_count(sketch[x[part]] ^ sketch[y[part]]).sum(axis=1, dtype=np.int64)
        fits[part] = 9 * apart <= n[x[part]] + n[y[part]]
    return fits


def _firsts(frame: pd.DataFrame, bounds: np.ndarray, near: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y: the first of each group takes all that may be near it, then the first of what is left."""
    group, left = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), np.arange(len(frame))
    while len(left):
        _, starts, many = np.unique(group[left], return_index=True, return_counts=True)
        first = np.repeat(left[starts], many)
        taken = near(first, left)
        others = taken & (first != left)
        yield first[others], left[others]
        left = left[~taken]


def _across(frame: pd.DataFrame, bounds: np.ndarray, near: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y of different components that may be near; in cells of kind 0 one of them is main."""
    component, main = frame["component"].to_numpy(np.int64), frame["main"].to_numpy(bool)
    among = frame["kind"].to_numpy(np.int64) == 1
    end, left, step = np.repeat(bounds[1:], np.diff(bounds)), np.arange(len(frame)), 1
    while len(left := left[left + step < end[left]]):
        y = left + step
        asked = (component[left] != component[y]) & (among[left] | main[left] | main[y])
        x, y = left[asked], y[asked]
        taken = near(x, y)
        yield x[taken], y[taken]
        step += 1


def _candidates(rows: DataFrame, sets: DataFrame, place: list[str], choose: Callable) -> DataFrame:
    """Distinct (pivot, cls) that ``choose`` takes from the cells of ``rows(*place, cls, n)``.

    Pivots come first in the order in which ``components`` hooks.
    """
    ordered = rows.withColumn("order", F.xxhash64("cls")).join(sets.select("cls", "sketch"), "cls")
    dealt = ordered.repartition(*place).sortWithinPartitions(*place, "order", "cls")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, place):  # a cell is a few blocks at most
            n, cls = frame["n"].to_numpy(np.int64), frame["cls"].to_numpy(np.int64)
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
            found, held = [np.zeros((0, 2), np.int64)], 0
            for x, y in choose(frame, bounds, partial(_may_link, n, sketch)):
                found.append(np.stack([cls[x], cls[y]], axis=1))
                held += len(x)
                if held > HELD:
                    yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["pivot", "cls"])
                    found, held = found[:1], 0
            yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["pivot", "cls"])

    return dealt.mapInPandas(search, PAIRS).distinct()


def _crossing(groups: DataFrame, own: DataFrame, cell: int) -> DataFrame:
    """Rows of the groups that have several components, dealt so that pairs of these share a cell.

    The members of the largest component of a group need not meet one another: each of their blocks
    meets the blocks of the rest (kind 0), and these meet among themselves (kind 1).
    """
    members = groups.join(own, "cls")
    by = members.groupBy("b", "component").agg(F.count("*").alias("rows"))
    most = F.max(F.struct("rows", "component")).alias("most")
    sizes = by.groupBy("b").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), most).where("parts > 1")
    # Blocks grow with the group, so that its rows are not copied too often.
    block = F.least(F.greatest(F.col("rows") / 16, F.lit(cell / 2)), F.lit(cell * 4.0))
    sizes = sizes.select(
        "b", F.col("most.component").alias("largest"), (F.col("rows") - F.col("most.rows")).alias("others"),
        F.ceil(F.col("most.rows") / block).cast("int").alias("blocks"),
        F.ceil((F.col("rows") - F.col("most.rows")) / block).cast("int").alias("rest"),
    )
    dealt = members.join(sizes, "b").withColumn("main", F.col("component") == F.col("largest"))
    mine = F.pmod(F.xxhash64("cls", "b"), F.when(F.col("main"), F.col("blocks")).otherwise(F.col("rest"))).cast("int")
    dealt = dealt.withColumn("mine", mine)

    def cells(kind, count, one, other):
        return F.transform(
            F.sequence(F.lit(0), F.col(count) - 1),
            lambda at: F.struct(F.lit(kind).alias("kind"), one(at).alias("x"), other(at).alias("y")),
        )

    own_block = F.col("mine")
    against = cells(0, "rest", lambda at: at, lambda at: own_block)
    asking = cells(0, "blocks", lambda at: own_block, lambda at: at)
    among = cells(1, "rest", lambda at: F.least(at, own_block), lambda at: F.greatest(at, own_block))
    where = F.when(F.col("main"), against).when(F.col("others") > 1, F.concat(asking, among)).otherwise(asking)
    return dealt.select("b", "cls", "n", "component", "main", F.explode(where).alias("at")).select(
        "b", "at.*", "cls", "n", "component", "main"
    )


def _linked(rare: DataFrame, alike: DataFrame, sets: DataFrame, label: str, block: int, cell: int) -> DataFrame:
    """(node, component) of the sets that are similar to another; groups are (b, cls, n, rows).

    Similar sets share a group of ``rare``; those of ``alike`` only help to find links early.
    """
    salt = F.pmod(F.xxhash64("cls", "b"), F.ceil(F.col("rows") / F.lit(cell))).cast("int")
    grouped = rare.unionByName(alike).select("b", salt.alias("salt"), "cls", "n")
    pairs = staged(_candidates(grouped, sets, ["b", "salt"], _firsts), label)
    met = staged(_compared(pairs, sets, block), label)
    discard(pairs)
    release(sets.sparkSession)
    known = components(met.where("near").select(F.col("pivot").alias("a"), F.col("cls").alias("b")), label)
    own = staged(
        sets.select("cls").join(known, F.col("cls") == F.col("node"), "left").select(
            "cls", F.coalesce("component", "cls").alias("component")
        ),
        label,
    )
    crossing = _candidates(_crossing(rare.drop("rows"), own, cell), sets, ["b", "kind", "x", "y"], _across)
    left = staged(crossing.join(met.select("pivot", "cls"), ["pivot", "cls"], "left_anti"), label)
    late = _compared(left, sets, block).where("near").select("pivot", "cls")
    for side in ("pivot", "cls"):
        at = own.select(F.col("cls").alias("node"), "component")
        late = late.join(at, F.col(side) == F.col("node")).select(
            *[F.col("component").alias(c) if c == side else F.col(c) for c in ("pivot", "cls")]
        )
    # These links join whole components, and sets that are alone so far.
    moved = components(late.select(F.col("pivot").alias("a"), F.col("cls").alias("b")), label).select(
        F.col("node").alias("at"), F.col("component").alias("into")
    )
    placed = own.join(moved, F.col("component") == F.col("at"), "left")
    return placed.select(F.col("cls").alias("node"), F.coalesce("into", "component").alias("component"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", label: str = "shingles", block: int = BLOCK, cell: int = CELL
) -> DataFrame:
    """(key, component_id) per row of ``docs(key, text)``; component_id is the smallest key.

    Texts link if at least four fifths of the distinct five-word shingles of both are common.
    Texts without words are alike; rows that repeat are kept.
    """

    @F.pandas_udf("cls long, n long, early binary")
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text)
            rows.append((_identity(found), len(found), found[: _first(len(found))].tobytes()))
        return pd.DataFrame(rows, columns=["cls", "n", "early"])

    @F.pandas_udf("cls long, data binary, sketch binary")
    def pack(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text)
            rows.append((_identity(found), found.tobytes(), _sketch(found)))
        return pd.DataFrame(rows, columns=["cls", "data", "sketch"])

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, WORDS) for t in texts], np.uint64).view(np.int64))

    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    looked = staged(
        docs.select(key, text_hash.alias("text_hash"), look("text").alias("set")).select(key, "text_hash", "set.*"),
        label,
    )
    coded = staged(looked.drop("early"), label)
    early = _members(looked.select("cls", F.col("early").alias("data")))
    # Copies of one set are one owner, so they are told apart by extremes, which combine early.
    shared = early.groupBy("h").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y")
    # A similar set may be smaller, by a fifth at most; the twentieth that both show is that of the smaller.
    # Copies of a set are counted each, so that more may stay, never fewer.
    seen = early.join(shared.select("h"), "h", "left_semi").groupBy("cls").agg(F.count("*").alias("seen"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 20))
    classes = coded.groupBy("cls").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"))
    left = staged(seen.join(classes, "cls").where(F.col("seen") >= need).select("cls", "n", "text_hash"), label)
    discard(looked)
    release(docs.sparkSession)
    # One text of each set that is left is cut into shingles again.
    texts = docs.select("text", text_hash.alias("text_hash")).join(left, "text_hash").dropDuplicates(["cls"])
    packed = texts.select("cls", "n", pack("text").alias("set"), prints("text").alias("code"))
    sets = staged(packed.where("cls = set.cls").select("cls", "n", "set.data", "set.sketch", "code"), label)
    release(docs.sparkSession)
    members = _members(sets)
    counted = members.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1")
    common = members.join(counted, "h").join(sets.select("cls", "n"), "cls")
    own = Window.partitionBy("cls")
    placed = common.withColumns(
        {"common": F.count("*").over(own), "place": F.row_number().over(own.orderBy("rows", "h"))}
    )
    # Members that no other set has come first, so a set with enough of them has no rival.
    room = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.col("common"))
    rare = placed.where(F.col("place") <= room).select(F.col("h").alias("b"), "cls", "n")
    trees = simhash.linked(sets.select("code").distinct(), label)
    alike = sets.join(trees, F.col("code") == F.col("node"), "left").select(
        F.xxhash64(F.lit("trees"), F.coalesce("component", "code")).alias("b"), "cls", "n"
    )
    groups = staged(rare.withColumn("rare", F.lit(True)).unionByName(alike.withColumn("rare", F.lit(False))), label)
    many = groups.groupBy("b").agg(F.count("*").alias("rows")).where("rows > 1")
    shared_groups = staged(groups.join(many, "b"), label)
    discard(groups)
    release(docs.sparkSession)
    rare, alike = (shared_groups.where(F.col("rare") == kind).drop("rare") for kind in (True, False))
    linked = _linked(rare, alike, sets, label, block, cell)
    firsts = coded.groupBy("cls").agg(F.min(key).alias("first"))
    named = firsts.join(linked, F.col("cls") == F.col("node"), "left").select(
        "cls", "first", F.coalesce("component", "cls").alias("group")
    )
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    owners = named.join(smallest, "group").select("cls", "component_id")
    return coded.select(key, "cls").join(owners, "cls").select(key, "component_id")
