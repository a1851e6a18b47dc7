"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed in blocks. A block holds the postings of the terms asked for, their impacts,
and for pairs of terms that a query has the list of documents with both and the largest impact that
the two reach together. A query splits into pairs; a block whose bounds do not add up to the score
of the query's last hit so far is skipped, and in others only documents of the pairs that such a sum
needs are looked at. A pair's bound is often far below the sum of its terms' own bounds, as rare
terms seldom meet where both are strong.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventrail.llm.common import ships_with_tasks, staged, table
from eventrail.llm.decontaminate import words_of

ships_with_tasks(__name__)

TOP = 20
#: Documents and postings in a block of the index.
BLOCK_DOCS = 1024
BLOCK_POSTINGS = 1 << 18
#: A pair keeps its list where the joint bound is below this share of the sum of both terms' own.
TIGHTER = 0.95
#: Bytes of query texts that are broadcast at once; more queries take several passes.
QUERY_BYTES = 4 << 20

POSTINGS = (
    "full long, words long, ids binary, unnamed binary, lengths binary, terms array<int>, sizes array<int>, "
    "places binary, counts binary"
)
IMPACTS = (
    "ids binary, unnamed binary, terms binary, sizes binary, places binary, impacts binary, most binary, "
    "pair_sizes binary, pair_places binary, pair_impacts binary, pair_most binary"
)


@dataclass
class Query:
    """A query as pairs (left, right) of terms with their repeats; right is -1 in a lone one."""

    name: int | None
    left: np.ndarray
    right: np.ndarray
    times_left: np.ndarray
    times_right: np.ndarray
    pair: np.ndarray

    def bounds(self, most: np.ndarray, pair_most: np.ndarray) -> np.ndarray:
        """The most that each pair can add to the score of a document of a block."""
        both = np.minimum(self.times_left, self.times_right)
        alone = self.times_left * most[self.left]
        joint = (
            both * pair_most[self.pair]
            + (self.times_left - both) * most[self.left]
            + (self.times_right - both) * most[self.right]
        )
        return np.where(self.right < 0, alone, joint)


def _paired(items: list[tuple[int | None, Counter]], weights: np.ndarray) -> tuple[list[Query], np.ndarray]:
    """The queries, their terms paired with those next in weight, and all pairs."""
    numbers: dict[tuple[int, int], int] = {}
    out = []
    for name, terms in items:
        order = sorted(terms, key=lambda t: (weights[t], t))
        left, right = order[::2], order[1::2]
        lone = len(left) - len(right)
        pair = [numbers.setdefault((a, b), len(numbers)) for a, b in zip(left, right, strict=False)]
        out.append(
            Query(
                name,
                np.array(left, np.int64),
                np.array(right + [-1] * lone, np.int64),
                np.array([terms[t] for t in left], np.int64),
                np.array([terms[t] for t in right] + [0] * lone, np.int64),
                np.array(pair + [-1] * lone, np.int64),
            )
        )
    return out, np.array(list(numbers), np.int64).reshape(-1, 2)


def _lists(sizes: np.ndarray, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    ends = np.cumsum(sizes).tolist()
    return [tuple(c[e - n : e] for c in columns) for e, n in zip(ends, sizes.tolist(), strict=True)]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of documents with the occurrences of the terms, and totals of all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        ids, unnamed, lengths, terms, places, counts = [], [], [], [], [], []
        size = 0

        def close() -> pd.DataFrame:
            found, place, count = (np.concatenate(x) for x in (terms, places, counts))
            order = np.argsort(found, kind="stable")
            names, sizes = np.unique(found, return_counts=True)
            lens = np.array(lengths, "<i8")
            row = {
                "full": [int((lens > 0).sum())],
                "words": [int(lens.sum())],
                "ids": [np.array(ids, "<i8").tobytes()],
                "unnamed": [np.array(unnamed, "?").tobytes()],
                "lengths": [lens.tobytes()],
                "terms": [names.astype(np.int32)],
                "sizes": [sizes.astype(np.int32)],
                "places": [place[order].astype("<u2").tobytes()],
                "counts": [count[order].astype("<i4").tobytes()],
            }
            for held in (ids, unnamed, lengths, terms, places, counts):
                held.clear()
            return pd.DataFrame(row)

        for batch in batches:
            for name, null, text in zip(batch["id"].tolist(), batch["unnamed"].tolist(), batch["text"], strict=True):
                words = words_of(text)
                known = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                found, many = np.unique(known[known >= 0], return_counts=True)
                terms.append(found)
                counts.append(many)
                places.append(np.full(len(found), len(ids), np.int32))
                ids.append(name)
                unnamed.append(null)
                lengths.append(len(words))
                size += len(found)
                if len(ids) == block_docs or size >= BLOCK_POSTINGS:
                    yield close()
                    size = 0
        if ids:
            yield close()

    null = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), null.alias("unnamed"), "text")
    return rows.mapInPandas(index, POSTINGS)


def impacts(blocks: DataFrame, weights: np.ndarray, pairs: np.ndarray, full: int, words: int) -> DataFrame:
    """The blocks with weighted impacts, and for pairs the documents with both terms.

    most: the largest impact of each term; pair_most: that of both together, in any document. A pair
    whose joint maximum is hardly below the sum of the two has no list (size -1).
    """
    shared = blocks.sparkSession.sparkContext.broadcast((weights, pairs))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, wanted = shared.value
        for batch in batches:
            for row in batch.itertuples():
                terms, sizes = np.array(row.terms, np.int64), np.array(row.sizes, np.int64)
                place, tf = np.frombuffer(row.places, "<u2"), np.frombuffer(row.counts, "<i4").astype(np.int64)
                m = 100 - 25 + (25 * np.frombuffer(row.lengths, "<i8") * full) // max(words, 1)
                impact = np.repeat(weight[terms], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[place]))
                most = np.zeros(len(weight), np.int64)
                starts = np.cumsum(sizes) - sizes
                if len(terms):
                    most[terms] = np.maximum.reduceat(impact, starts)
                held = dict(zip(terms.tolist(), _lists(sizes, place, impact), strict=True))
                pair_most = np.maximum(most[wanted[:, 0]], most[wanted[:, 1]])
                loose = TIGHTER * (most[wanted[:, 0]] + most[wanted[:, 1]])
                pair_sizes = np.zeros(len(wanted), np.int32)
                both_places, both_impacts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
                column = np.zeros(len(m), np.int64)
                there = np.zeros(len(m), bool)
                last = -1
                # Pairs of one left term follow one another, so its list is spread out once.
                for n in np.argsort(wanted[:, 0], kind="stable").tolist():
                    a, b = wanted[n].tolist()
                    if a not in held or b not in held:
                        continue
                    if a != last:
                        if last >= 0:
                            there[held[last][0]] = False
                        column[held[a][0]], there[held[a][0]], last = held[a][1], True, a
                    at, own = held[b]
                    hit = there[at]
                    if hit.any():
                        at, joint = at[hit], own[hit] + column[at[hit]]
                        pair_most[n] = max(pair_most[n], joint.max())
                        if pair_most[n] > loose[n]:
                            pair_sizes[n] = -1
                            continue
                        pair_sizes[n] = len(at)
                        both_places.append((n, at))
                        both_impacts.append((n, joint))
                both_places = [x for _, x in sorted(both_places[1:], key=lambda p: p[0])] or both_places[:1]
                both_impacts = [x for _, x in sorted(both_impacts[1:], key=lambda p: p[0])] or both_impacts[:1]
                data = {
                    "ids": row.ids,
                    "unnamed": row.unnamed,
                    "terms": terms.astype("<i4").tobytes(),
                    "sizes": sizes.astype("<i4").tobytes(),
                    "places": row.places,
                    "impacts": impact.astype("<i8").tobytes(),
                    "most": most.astype("<i8").tobytes(),
                    "pair_sizes": pair_sizes.astype("<i4").tobytes(),
                    "pair_places": np.concatenate(both_places).astype("<u2").tobytes(),
                    "pair_impacts": np.concatenate(both_impacts).astype("<i8").tobytes(),
                    "pair_most": pair_most.astype("<i8").tobytes(),
                }
                yield pd.DataFrame({k: [v] for k, v in data.items()})

    return blocks.mapInPandas(weigh, IMPACTS)


class Block:
    """A block of the index in memory."""

    def __init__(self, row: tuple) -> None:
        self.ids, self.unnamed = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.unnamed, "?")
        terms, sizes = np.frombuffer(row.terms, "<i4"), np.frombuffer(row.sizes, "<i4")
        places, found = np.frombuffer(row.places, "<u2"), np.frombuffer(row.impacts, "<i8")
        self.lists = dict(zip(terms.tolist(), _lists(sizes, places, found), strict=True))
        sizes = np.frombuffer(row.pair_sizes, "<i4")
        places, found = np.frombuffer(row.pair_places, "<u2"), np.frombuffer(row.pair_impacts, "<i8")
        self.pairs = _lists(np.maximum(sizes, 0), places, found)
        self.listed = sizes >= 0
        self.most, self.pair_most = np.frombuffer(row.most, "<i8"), np.frombuffer(row.pair_most, "<i8")

    def _single(self, term: int, at: np.ndarray) -> np.ndarray:
        return _looked_up(*self.lists[term], at) if term in self.lists else np.zeros(len(at), np.int64)

    def _added(self, query: Query, unit: int, at: np.ndarray) -> np.ndarray:
        """What a pair of the query adds to the documents ``at``."""
        left, right = int(query.left[unit]), int(query.right[unit])
        times, other = int(query.times_left[unit]), int(query.times_right[unit])
        if right >= 0 and times == other and self.listed[query.pair[unit]]:
            places, joint = self.pairs[query.pair[unit]]
            out = times * _looked_up(places, joint, at)
            rest = np.flatnonzero(out == 0)
            # Outside the list of both a document has one of the terms at most.
            out[rest] = times * (self._single(left, at[rest]) + self._single(right, at[rest]))
            return out
        out = times * self._single(left, at)
        return out if right < 0 else out + other * self._single(right, at)

    def search(self, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score ``least`` or more, and above 0."""
        none = np.zeros(0, np.int64)
        bound = query.bounds(self.most, self.pair_most)
        if bound.sum() < max(least, 1):
            return none, none
        order = np.argsort(bound, kind="stable")
        needed = int(np.searchsorted(np.cumsum(bound[order]), max(least, 1), "left"))
        score = np.zeros(len(self.ids), np.int64)
        for unit in order[needed:].tolist():
            for term, times in (
                (int(query.left[unit]), query.times_left[unit]),
                (int(query.right[unit]), query.times_right[unit]),
            ):
                if term in self.lists:
                    places, found = self.lists[term]
                    score[places] += times * found
        rest = int(bound[order[:needed]].sum())
        at = np.flatnonzero((score > 0) & (score + rest >= least))
        for unit in order[:needed][::-1].tolist():
            if not len(at):
                break
            rest -= int(bound[unit])
            score[at] += self._added(query, unit, at)
            at = at[score[at] + rest >= least]
        return at, score[at]


def _looked_up(places: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the places ``at``, 0 where there is none."""
    if not len(places):
        return np.zeros(len(at), np.int64)
    n = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return np.where(places[n] == at, values[n], 0)


class Best:
    """The hits of a query so far: highest scores first, equal ones by key, null keys last."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 0
        self.score, self.ids, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        ids, unnamed = np.concatenate([self.ids, ids]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -score))[: self.top]
        self.score, self.ids, self.unnamed = score[order], ids[order], unnamed[order]
        if len(order) == self.top:
            self.least = int(self.score[-1])


def _hits(index: DataFrame, queries: list[Query], top: int) -> DataFrame:
    """(query, doc_id, score): the best of each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        best = [Best(top) for _ in asked]
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row)
                for query, held in zip(asked, best, strict=True):
                    at, score = block.search(query, held.least)
                    if len(at):
                        held.add(score, block.ids[at], block.unnamed[at])
        found = [(n, h) for n, h in enumerate(best) if len(h.score)]
        if found:
            unnamed = np.concatenate([h.unnamed for _, h in found])
            yield pd.DataFrame(
                {
                    "query": np.repeat([n for n, _ in found], [len(h.score) for _, h in found]),
                    "doc_id": pd.arrays.IntegerArray(np.concatenate([h.ids for _, h in found]), unnamed),
                    "score": np.concatenate([h.score for _, h in found]),
                }
            )

    return index.mapInPandas(search, "query int, doc_id long, score long")


def _ranked(docs: DataFrame, rows: list, top: int, block_docs: int, label: str) -> DataFrame:
    """The hits of queries that are few enough to be sent to every task."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for name, text in rows:
        terms = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text))
        items.append((name, terms))
    spark = docs.sparkSession
    blocks = staged(postings(docs, vocabulary, block_docs), label)
    totals = blocks.agg(F.sum("full"), F.sum("words")).first()
    full, words = (int(x or 0) for x in totals)
    lists = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("list"))
    # At most one row per term of the queries.
    known = lists.groupBy("list.terms").agg(F.sum("list.sizes").alias("df")).toPandas()
    held = np.zeros(len(vocabulary), np.int64)
    held[known["terms"].to_numpy(np.int64)] = known["df"].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * full + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
    queries, pairs = _paired(items, weights)
    index = staged(impacts(blocks, weights, pairs, full, words), label)
    names = spark.createDataFrame([(n, q.name) for n, q in enumerate(queries)], "query int, item_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = _hits(index, queries, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    query_bytes: int = QUERY_BYTES,
    block_docs: int = BLOCK_DOCS,
    label: str = "ranked",
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``queries(item_id, text)`` the best of ``docs(doc_id, text)``.

    Rows that repeat are one query; different texts of one item_id are queries of their own, and
    may have a null item_id. Every row of ``docs`` counts and is ranked, with a null doc_id after
    others of its score. Null texts have no terms; queries without terms have no hits. Queries
    above ``query_bytes`` are taken in blocks, one pass over the documents each.
    """
    spark = docs.sparkSession
    asked = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n in range(blocks if size else 0):
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n
        rows = [(r["item_id"], r["text"]) for r in asked.where(block).collect()]
        if rows:
            out = out.unionAll(_ranked(docs, rows, top, block_docs, label))
    return out


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that score highest for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
item AS (
  SELECT i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark))),
asked AS (SELECT i, item_id, t, count(*) AS times FROM item GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words)) AS n_words FROM doc),
tfs AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
dfs AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * n + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS n FROM tfs GROUP BY t), totals),
impacts AS (
  SELECT r, doc_id, t, w * ((1000000000 * tf)
    // (1000 * tf + 12 * (100 - 25 + ((25 * len(words) * n_docs) // n_words)))) AS impact
  FROM tfs JOIN dfs USING (t) JOIN doc USING (r), totals),
scores AS (
  SELECT i, item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM asked JOIN impacts USING (t) GROUP BY i, item_id, r HAVING sum(times * impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores)
WHERE rank <= 20
"""
