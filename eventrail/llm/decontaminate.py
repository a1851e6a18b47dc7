"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ten consecutive words of an item. Its shingles are word pairs, ordered by their
rarity over all documents; full containment needs the rarest one only, so the prefix is one
shingle. An occurrence of it in a document fixes where the window would lie; length and
positional bounds discard what would not fit, and the words of what remains are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import ships_with_tasks, staged, table

ships_with_tasks(__name__)

WINDOW = 10
#: Words of benchmark items that are broadcast at once; a larger benchmark takes several blocks.
BLOCK_WORDS = 2_000_000
HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"

#: ASCII letters in lower case; ASCII that is no letter or digit separates words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Index:
    """Windows of a block of items, by word numbers; shingles numbered in ascending order."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        rows, sizes, owners, named = [], [], [], []
        number = self.vocabulary.setdefault
        for item, words in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                rows.append(ids[start : start + size] + [0] * (window - size))
                sizes.append(size)
                owners.append(-1 if item is None else item)
                named.append(item is not None)
        self.windows = np.array(rows, np.int32).reshape(-1, window)
        self.sizes = np.array(sizes, np.int32)
        self.owners = np.array(owners, np.int64)
        self.named = np.array(named, bool)
        self.base = len(self.vocabulary) + 1
        self.codes = np.unique(self._pairs()) if len(rows) else np.zeros(0, np.int64)
        self.codes = self.codes[self.codes >= 0]
        self.prefix: np.ndarray | None = None

    def _pairs(self) -> np.ndarray:
        """Shingle codes of each window, -1 beyond its end; a lone word is paired with 0."""
        left = self.windows.astype(np.int64)
        right = np.zeros_like(left)
        right[:, :-1] = left[:, 1:]
        codes = left * self.base + right
        at = np.arange(left.shape[1])
        codes[at[None, :] >= np.maximum(self.sizes - 1, 1)[:, None]] = -1
        return codes

    def rank(self, counts: np.ndarray) -> None:
        """Choose the prefix of every window, given how often each shingle occurs."""
        codes = self._pairs()
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        rarity = np.where(codes >= 0, counts[at] if len(counts) else 0, np.iinfo(np.int64).max)
        self.offset = rarity.argmin(axis=1) if len(codes) else np.zeros(0, np.int64)
        rows = np.arange(len(codes))
        alive = rarity[rows, self.offset] > 0  # a shingle that never occurs rules the window out
        code = codes[rows, self.offset]
        order = np.argsort(code[alive], kind="stable")
        self.by_code = rows[alive][order]
        self.prefix = code[alive][order]

    def numbers(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (0: in no item), and the shingle code at each word."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        return ids, ids * self.base

    def occurrences(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers; codes and positions of shingles whose words are all item words."""
        ids, codes = self.numbers(text)
        single = np.flatnonzero(ids)
        pair = single[single < len(ids) - 1]
        pair = pair[ids[pair + 1] > 0]
        return (
            ids,
            np.concatenate([codes[single], codes[pair] + ids[pair + 1]]),
            np.concatenate([single, pair]),
        )

    def count(self, text: str | None, into: np.ndarray) -> None:
        _, codes, _ = self.occurrences(text)
        if len(codes) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            into += np.bincount(at[self.codes[at] == codes], minlength=len(into))

    def match(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, maximal runs of words inside occurring windows, items that occur."""
        ids, codes, places = self.occurrences(text)
        lo = np.searchsorted(self.prefix, codes, "left")
        many = np.searchsorted(self.prefix, codes, "right") - lo
        if not many.any():
            return len(ids), [], []
        # One row per occurrence and window that has it as its prefix.
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        window = self.by_code[first + np.arange(many.sum())]
        start = np.repeat(places, many) - self.offset[window]
        fits = (start >= 0) & (start + self.sizes[window] <= len(ids))
        window, start = window[fits], start[fits]
        for step in range(self.windows.shape[1]):
            wanted = self.windows[window, step]
            at = np.minimum(start + step, len(ids) - 1)
            same = (wanted == 0) | (ids[at] == wanted)
            window, start = window[same], start[same]
        if not len(window):
            return len(ids), [], []
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.sizes[window], -1)
        hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(hit))
        spans = [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
        return len(ids), spans, np.unique(self.owners[window][self.named[window]]).tolist()


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of at most ``limit`` words (or one item), one partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield block


def _rarities(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each shingle of the index occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index.__dict__)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index.__new__(Index)
        own.__dict__.update(shared.value)
        counts = np.zeros(len(own.codes), np.int64)
        for batch in batches:
            for text in batch["text"]:
                own.count(text, counts)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"shingle": seen, "n": counts[seen]})

    # At most one row per shingle of the block.
    sums = docs.select("text").mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n")
    )
    out = np.zeros(len(index.codes), np.int64)
    frame = sums.toPandas()
    out[frame["shingle"].to_numpy(np.int64)] = frame["n"].to_numpy(np.int64)
    return out


def _searcher(spark: SparkSession, index: Index) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(index.__dict__)

    @F.pandas_udf(HITS)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Index.__new__(Index)
        own.__dict__.update(shared.value)
        for batch in texts:
            rows = [own.match(text) for text in batch]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search


def _merged(parts: list[dict]) -> tuple[int, list[tuple[int, int]], list[int]]:
    """The result of several blocks of items as one."""
    spans: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for p in parts for s in p["spans"]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    items = sorted({i for p in parts for i in p["items"]})
    return parts[0]["n_words"], [(a, b) for a, b in spans], items


def contamination(
    docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with ``hits``: n_words, spans of hit words, and the item_ids that occur.

    ``docs`` needs ``text``; ``benchmark`` needs ``item_id`` and ``text``. Null and empty texts
    have no words and no hits. Items without words have no windows; an item with a null id makes
    hits but is not listed; ids that repeat are listed once. A benchmark above ``block_words``
    is taken in blocks, each broadcast on its own and its hits stored before the next, so memory
    is bounded at any size. Other columns pass unchanged, but for an existing ``hits``.
    """
    out = docs.drop("hits")
    more = "more"
    while more in out.columns:
        more += "_"

    @F.pandas_udf(HITS)
    def merge(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_merged(list(p)) for p in parts], columns=["n_words", "spans", "items"])

    for n, block in enumerate(_blocks(benchmark, block_words)):
        index = Index(block)
        index.rank(_rarities(docs, index))
        search = _searcher(docs.sparkSession, index)
        if n == 0:
            out = out.withColumn("hits", search(F.col("text")))
            continue
        # What is found so far is stored, so that tasks hold the index of one block only.
        both = staged(out, "decontaminate").withColumn(more, search(F.col("text")))
        out = both.withColumn("hits", merge(F.array("hits", more))).drop(more)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        lengths.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: Words, windows and n-grams by list functions; an n-gram is compared as its joined words.
ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, item_id FROM grams JOIN windows USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
