"""Line dedup that can be undone: cuckoo filters by shard in front of exact reference counts.

An index holds one reference per line key and document, the number of documents and the largest
document of every key, and, for each shard of the keys, a cuckoo filter of those that enough
documents hold. Documents are inserted and deleted; a key enters or leaves its filter when its
count crosses the bound. Lines are asked of the filters first; what they let through is looked
up in the exact counts, so a filter's errors cost work and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import ships_with_tasks, staged, table, whole_groups

ships_with_tasks(__name__)

#: Code points that a key needs, and documents that must hold it.
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Keys that a shard's filter is made for; an index with more keys gets more shards.
SHARD_KEYS = 1 << 16
#: Cells that each shard's lines are dealt to, so that a shard with a frequent line is many tasks.
SALTS = 32
BLANKS = b" \t\n\x0b\x0c\r"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLOTS = 4
_KICKS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each key has two buckets it may lie in."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for twice the keys at least."""
        return cls(np.zeros((1 << max(3, (keys // 2).bit_length()), _SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, _SLOTS).copy())

    def data(self) -> bytes:
        return self.buckets.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = keys.view(np.uint64)
        prints = (hashed >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        return prints.astype(np.uint16), (hashed & np.uint64(len(self.buckets) - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        jump = (prints.astype(np.uint64) * _MIX) >> np.uint64(32)
        return at ^ (jump & np.uint64(len(self.buckets) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be there; false only for keys that are not."""
        prints, at = self._places(keys)
        mine, other = self.buckets[at], self.buckets[self._other(at, prints)]
        return (mine == prints[:, None]).any(1) | (other == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add the keys, one entry each; false if they find no room, then the filter is spoilt."""
        prints, at = self._places(keys)
        for turn in range(_KICKS):
            for _ in range(2):
                order = np.argsort(at, kind="stable")
                prints, at = prints[order], at[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
                free = self.buckets[at] == 0
                slot = free & (free.cumsum(1) == rank[:, None] + 1)
                fits = slot.any(1)
                self.buckets[at[fits], slot[fits].argmax(1)] = prints[fits]
                prints, at = prints[~fits], at[~fits]
                if not len(at):
                    return True
                at = self._other(at, prints)
            # One key of each crowded bucket takes the place of another, which moves on.
            first = np.unique(at, return_index=True)[1]
            slot = (turn + at[first]) % _SLOTS
            out = self.buckets[at[first], slot]
            self.buckets[at[first], slot] = prints[first]
            prints[first] = out
            at[first] = self._other(at[first], out)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove one entry for each key; the keys must have been inserted."""
        prints, at = self._places(keys)
        while len(at):
            pair = np.minimum(at, self._other(at, prints)) * 65536 + prints
            first = np.unique(pair, return_index=True)[1]
            p, a = prints[first], at[first]
            there = (self.buckets[a] == p[:, None]).any(1)
            a = np.where(there, a, self._other(a, p))
            slot = (self.buckets[a] == p[:, None]).argmax(1)
            self.buckets[a, slot] = 0
            rest = np.ones(len(at), bool)
            rest[first] = False
            prints, at = prints[rest], at[rest]


@dataclass(frozen=True)
class LineIndex:
    """The state after some insertions and deletions; tables in the shared folder."""

    refs: DataFrame  # k1, k2, doc_id: the document holds the key
    counts: DataFrame  # k1, k2, docs, last: documents with the key, and the largest of them
    filters: DataFrame  # shard, data: keys that enough documents hold
    shards: int
    least_docs: int
    least_chars: int


def line_keys(text: str | None, least_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, 128 bits of the key) of the lines whose key is long enough."""
    for place, line in enumerate((text or "").encode("utf-8", "replace").translate(_LOWER).split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
            yield place, xxhash.xxh3_128_digest(key)


def _lines(rows: DataFrame, names: list[str], least_chars: int) -> DataFrame:
    """``rows(*names, doc, text)`` by line: names, doc (the doc_id as text), pos, k1, k2."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [list(line_keys(text, least_chars)) for text in batch["text"]]
            many = [len(f) for f in found]
            out = {c: np.repeat(batch[c].to_numpy(), many) for c in [*names, "doc"]}
            out["pos"] = np.array([place for f in found for place, _ in f], np.int32)
            keys = np.frombuffer(b"".join(key for f in found for _, key in f), "<i8").reshape(-1, 2)
            yield pd.DataFrame({**out, "k1": keys[:, 0], "k2": keys[:, 1]})

    kinds = "".join(f"{c} long, " for c in names) + "doc string, pos int, k1 long, k2 long"
    return rows.select(*names, "doc", "text").mapInPandas(split, kinds)


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def _references(docs: DataFrame, least_chars: int) -> DataFrame:
    """(k1, k2, doc_id), once for each key of a document."""
    keys = _lines(docs.select(F.col("doc_id").cast("string").alias("doc"), "text"), [], least_chars)
    return keys.select("k1", "k2", F.col("doc").cast("long").alias("doc_id")).distinct()


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def _held(refs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """References with (left_semi) or without (left_anti) the documents of ``ids``, nulls too."""
    other = ids.select(F.col("doc_id").alias("__id")).distinct()
    return refs.join(other, refs["doc_id"].eqNullSafe(other["__id"]), how)


def _built(counts: DataFrame, least_docs: int, label: str) -> tuple[DataFrame, int]:
    """Filters of all keys that enough documents hold, and the number of shards."""
    often = counts.where(F.col("docs") >= least_docs)
    shards = max(16, -(-often.count() // SHARD_KEYS))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["shard"]):  # about SHARD_KEYS keys each
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                keys, room = frame["k2"].to_numpy(np.int64)[lo:hi], int(hi - lo)
                made = CuckooFilter.sized(room)
                while not made.insert(keys):
                    room *= 2
                    made = CuckooFilter.sized(room)
                yield pd.DataFrame({"shard": [frame["shard"].iloc[lo]], "data": [made.data()]})

    dealt = often.select(_shard(shards), "k2").repartition("shard").sortWithinPartitions("shard")
    return staged(dealt.mapInPandas(build, "shard int, data binary"), label), shards


def _updated(index: LineIndex, changes: DataFrame, counts: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The filters after ``changes(k1, k2, step)``: keys that enter (1) or leave (-1).

    If a filter has no room left, all are built anew from the exact counts.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["shard"]):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = frame.iloc[lo:hi]
                step, keys = part["step"].to_numpy(np.int64), part["k2"].to_numpy(np.int64)
                old = part["data"].iloc[0]
                held = CuckooFilter.sized(256) if old is None else CuckooFilter.read(old)
                held.delete(keys[step == -1])
                whole = held.insert(keys[step == 1])
                yield pd.DataFrame({"shard": [part["shard"].iloc[0]], "data": [held.data() if whole else None]})

    moved = changes.select(_shard(index.shards), "k2", "step", F.lit(None).cast("binary").alias("data"))
    old = index.filters.select("shard", F.lit(0).cast("long").alias("k2"), F.lit(0).alias("step"), "data")
    rows = old.unionByName(moved).repartition("shard").sortWithinPartitions("shard", F.col("data").desc_nulls_last())
    filters = staged(rows.mapInPandas(apply, "shard int, data binary"), label)
    if filters.where("data is null").isEmpty():
        return filters, index.shards
    return _built(counts, index.least_docs, label)


def build(
    docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, label: str = "lines"
) -> LineIndex:
    """An index of ``docs(doc_id, text)``.

    Rows of one doc_id are one document, also those with a null doc_id, which is the smallest.
    """
    refs = staged(_references(docs, least_chars), label)
    counts = staged(_counted(refs), label)
    return LineIndex(refs, counts, *_built(counts, least_docs, label), least_docs, least_chars)


def insert(index: LineIndex, docs: DataFrame, label: str = "lines") -> LineIndex:
    """The index with more documents; references that it has already are not counted again."""
    new, old = _references(docs, index.least_chars).alias("n"), index.refs.alias("o")
    same = (F.col("n.k1") == F.col("o.k1")) & (F.col("n.k2") == F.col("o.k2")) & F.expr("n.doc_id <=> o.doc_id")
    new = staged(new.join(old, same, "left_anti"), label)
    added = _counted(new).withColumn("fresh", F.lit(True))
    both = index.counts.withColumn("fresh", F.lit(False)).unionByName(added)
    merged = staged(
        both.groupBy("k1", "k2").agg(
            F.sum("docs").alias("docs"),
            F.max("last").alias("last"),
            F.sum(F.when(F.col("fresh"), 0).otherwise(F.col("docs"))).alias("before"),
        ),
        label,
    )
    counts = merged.select("k1", "k2", "docs", "last")
    entered = (F.col("docs") >= index.least_docs) & (F.col("before") < index.least_docs)
    changes = merged.where(entered).select("k1", "k2", F.lit(1).alias("step"))
    filters, shards = _updated(index, changes, counts, label)
    return LineIndex(
        index.refs.unionByName(new), counts, filters, shards, index.least_docs, index.least_chars
    )


def delete(index: LineIndex, ids: DataFrame, label: str = "lines") -> LineIndex:
    """The index without the documents whose ``doc_id`` is in ``ids``; unknown ones change nothing."""
    touched = staged(_held(index.refs, ids, "left_semi").select("k1", "k2").distinct(), label)
    refs = staged(_held(index.refs, ids, "left_anti"), label)
    key = ["k1", "k2"]
    after = _counted(refs.join(touched, key, "left_semi"))
    counts = staged(index.counts.join(touched, key, "left_anti").unionByName(after), label)
    was = index.counts.join(touched, key, "left_semi").where(F.col("docs") >= index.least_docs)
    still = counts.where(F.col("docs") >= index.least_docs)
    changes = was.join(still, key, "left_anti").select("k1", "k2", F.lit(-1).alias("step"))
    filters, shards = _updated(index, changes, counts, label)
    return LineIndex(refs, counts, filters, shards, index.least_docs, index.least_chars)


def _let_through(index: LineIndex, lines: DataFrame) -> DataFrame:
    """The rows of ``lines(r1, r2, doc, pos, k1, k2)`` whose key a filter may hold.

    Each cell gets its shard's filter as its first row, so a task holds one filter at a time.
    """
    shards = index.shards
    asked = lines.withColumn("shard", _shard(shards)).withColumn("salt", F.pmod("r1", F.lit(SALTS)).cast("int"))
    # Numbers next to nulls would reach Python as floats.
    zero = {c: F.lit(0).cast("long") for c in ("r1", "r2", "k1", "k2")}
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = index.filters.withColumns({**zero, "doc": F.lit(None).cast("string"), "pos": F.lit(0), "salt": salts})
    asked = asked.select(*zero, "doc", "pos", "shard", "salt")
    cells = copies.unionByName(asked.withColumn("data", F.lit(None).cast("binary")))
    columns = ["r1", "r2", "doc", "pos", "k1", "k2"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, None
        for batch in batches:
            where = batch["shard"].to_numpy(np.int64) * SALTS + batch["salt"].to_numpy(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.iloc[lo:hi]
                if where[lo] != cell:
                    cell, data = where[lo], part["data"].iloc[0]
                    held = None if data is None else CuckooFilter.read(data)
                    part = part if held is None else part.iloc[1:]
                if held is not None and len(part):
                    rows = part[columns]
                    yield rows[held.holds(rows["k2"].to_numpy(np.int64))]

    dealt = cells.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").desc_nulls_last())
    through = dealt.mapInPandas(ask, "r1 long, r2 long, doc string, pos int, k1 long, k2 long")
    return through.withColumn("doc_id", F.col("doc").cast("long")).drop("doc")


def dedup(index: LineIndex, docs: DataFrame) -> DataFrame:
    """``docs`` with ``dedup``: n_lines and n_dropped (long), and the text that is kept.

    A line goes if enough documents of the index hold its key and the row's document is not the
    largest of them. A null or empty text is one empty line. Rows that repeat are treated alike; other columns
    pass, but for an existing ``dedup``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    unnamed = F.col("doc_id").isNull()
    named = [
        F.xxhash64(F.col("doc_id"), unnamed, text).alias("r1"),
        F.xxhash64(F.lit("row"), text, unnamed, F.col("doc_id")).alias("r2"),
    ]
    passed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "dedup"]).alias("row")
    rows = docs.select(passed, text.alias("text"), *named)
    named_rows = docs.select(*named, F.col("doc_id").cast("string").alias("doc"), "text")
    lines = _lines(named_rows, ["r1", "r2"], index.least_chars)
    often = index.counts.where(F.col("docs") >= index.least_docs).select("k1", "k2", "last")
    gone = (
        _let_through(index, lines)
        .join(often, ["k1", "k2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("gone"))
    )

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def cut(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        out = []
        for text, places in zip(texts, dropped, strict=True):
            lines = text.split("\n")
            if places is None:
                out.append((len(lines), 0, text))
            else:
                away = set(places.tolist())
                kept = "\n".join(line for n, line in enumerate(lines) if n not in away)
                out.append((len(lines), len(away), kept))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    found = rows.join(gone, ["r1", "r2"], "left").select("row", cut("text", "gone").alias("dedup"))
    return found.select("row.*", "dedup")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and its text without the lines that others keep."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup(build(docs), docs)
    kept = F.sha2(F.col("dedup.kept"), 256).alias("kept_sha256")
    return found.select("doc_id", "dedup.n_lines", "dedup.n_dropped", kept)


ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM rows),
keys AS (
  SELECT r, doc_id, pos, line, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT k, doc_id FROM keys WHERE length(k) >= 20)
  GROUP BY k HAVING count(*) >= 3),
judged AS (
  SELECT r, keys.doc_id, pos, line, often.k IS NOT NULL AND keys.doc_id IS DISTINCT FROM last AS gone
  FROM keys LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
