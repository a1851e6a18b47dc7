"""SimHash near-duplicates linked through BK-trees.

Documents get 64-bit fingerprints; equal ones form one class. Fingerprints within the radius
agree in at least two of five blocks of bits, so every pair of blocks is a bucket key. Each
bucket holds BK-trees of bounded size (children keyed by their Hamming distance to the parent);
a bucket above the bound is cut into several trees, and every tree is sent to every block
of queries of its bucket. A search follows only edges within the radius. A task joins what it
links at once and passes on a spanning forest, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventrail.llm.common import components, ships_with_tasks, staged, table, whole_groups

ships_with_tasks(__name__)

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints in one BK-tree.
TREE_NODES = 1024
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles of the whole text; 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(s, seed) for s in shingles), ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class BKTree:
    """Node numbers by fingerprint; the children of a node are keyed by distance to it."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        at, new = 0, len(self.codes)
        if new:
            while (step := (code ^ self.codes[at]).bit_count()) in self.children[at]:
                at = self.children[at][step]
            self.children[at][step] = new
        self.codes.append(code)
        self.children.append({})
        return new

    def within(self, code: int, radius: int) -> Iterator[int]:
        todo = [0] if self.codes else []
        while todo:
            at = todo.pop()
            distance = (code ^ self.codes[at]).bit_count()
            if distance <= radius:
                yield at
            for step, child in self.children[at].items():
                if abs(step - distance) <= radius:
                    todo.append(child)


def _forest(nodes: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (fingerprint, first fingerprint of its group) among a tree and its queries.

    Without queries the nodes of the tree are compared with one another.
    """
    tree = BKTree()
    codes = nodes + queries
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    for at, code in enumerate(nodes):
        if not queries:
            for near in tree.within(code, radius):
                join(at, near)
        tree.add(code)
    for at, code in enumerate(queries, len(nodes)):
        for near in tree.within(code, radius):
            join(at, near)
    return [(code, codes[root(at)]) for at, code in enumerate(codes) if root(at) != at]


def _bucket_keys(code: Column) -> Column:
    """One number for each pair of blocks: which pair, and the bits of both."""
    keys = []
    for n, (x, y) in enumerate(combinations(_BLOCKS, 2)):
        bits = [
            F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1)) for start, width in (x, y)
        ]
        keys.append(F.lit(n << 26) + bits[0] * F.lit(1 << 13) + bits[1])
    return F.array(*keys)


def linked(codes: DataFrame, label: str, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(node, component) of every fingerprint in ``codes(code)`` that has a near one.

    ``codes`` must be distinct; ``radius`` is 3 at most, which the bucket keys rely on.
    """
    if radius > 3:
        raise ValueError("two of five blocks agree for a radius of 3 at most")
    entries = codes.select("code", F.explode(_bucket_keys(F.col("code"))).alias("key"))
    full = entries.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shards = F.ceil(F.col("rows") / F.lit(tree_nodes)).cast("int")
    shared = entries.join(full, "key").select("key", "code", shards.alias("shards"))
    mine = F.pmod(F.xxhash64("code"), F.col("shards")).cast("int")
    # A shard is a tree in the cells (shard, q <= shard), and queries in the cells (t >= shard, shard).
    cells = shared.withColumn("mine", mine).select(
        "key",
        "code",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("shards") - 1),
                lambda other: F.struct(
                    F.greatest(other, F.col("mine")).alias("tree"),
                    F.least(other, F.col("mine")).alias("asked"),
                    (other <= F.col("mine")).alias("node"),
                ),
            )
        ).alias("cell"),
    ).select("key", "cell.*", "code")
    place = ["key", "tree", "asked"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, place):  # a group is two shards at most
            found: list[tuple[int, int]] = []
            code = frame["code"].to_numpy(np.int64).view(np.uint64)
            node = frame["node"].to_numpy(bool)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    part, flag = code[lo:hi], node[lo:hi]
                    found += _forest(part[flag].tolist(), part[~flag].tolist(), radius)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = cells.repartition(*place).sortWithinPartitions(*place, "code")
    return components(dealt.mapInPandas(search, "a long, b long"), label)


def near_duplicates(docs: DataFrame, key: str = "doc_id", label: str = "simhash") -> DataFrame:
    """(key, code, component_id) per row of ``docs(key, text)``.

    ``component_id`` is the smallest key reachable over links of fingerprints that differ in
    3 bits or fewer. Null and empty texts have fingerprint 0 and are linked like any other.
    Rows with a null key belong to a component but never name it; repeated rows are kept; an
    empty table gives an empty result.
    """
    coded = staged(docs.select(key, fingerprints(F.col("text")).alias("code")), label)
    classes = coded.groupBy("code").agg(F.min(key).alias("first"))
    groups = linked(classes.select("code"), label)
    named = classes.join(groups, F.col("code") == F.col("node"), "left").select(
        "code", "first", F.coalesce("component", "code").alias("group")
    )
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    owners = named.join(smallest, "group").select("code", "component_id")
    return coded.join(owners, "code").select(key, "code", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )
