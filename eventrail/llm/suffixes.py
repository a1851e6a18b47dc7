"""Removal of repeated byte strings by suffix sorting with difference covers.

Every 100-byte string is owned by the smallest hashed gram inside it. Strings that are equal have
equal owners, so texts can be cut into contexts (the strings that one gram owns, at most 168
bytes) and dealt by gram: equal strings meet wherever they come from. A context that is the
same as an earlier one is removed at once. The others that share a gram are suffix-sorted by
the difference-cover algorithm: sampled triples are sorted and named, names are sorted
recursively, the remaining suffixes are merged in, and prefixes of adjacent suffixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import release, ships_with_tasks, staged, table

ships_with_tasks(__name__)

LENGTH = 100
GRAM = 24
#: Contexts of one gram that are sorted in one task; grams above it go by single strings.
GRAM_CONTEXTS = 4096
#: Crowded grams that may be broadcast, at 16 bytes each; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
#: Bytes that are suffix-sorted at once.
CHUNK = 1 << 18
_BLOCK = 1 << 17  # strings whose owners are found at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number per byte, and the powers of the base and of its inverse."""
    size = _BLOCK + 2 * LENGTH
    of_byte = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up = np.cumprod(np.full(size, _BASE, np.uint64))
    down = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), np.uint64))
    one = np.ones(1, np.uint64)
    return of_byte, np.concatenate([one, up]), np.concatenate([one, down])


class Anchors:
    """Finds the gram that owns each string of a text."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        self.tables = _hash_tables()

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, context hash, first string, strings) of every context of the text."""
        parts = [
            self._block(data[at : at + _BLOCK + self.length - 1], at)
            for at in range(0, max(len(data) - self.length + 1, 0), _BLOCK)
        ]
        if not parts:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty
        gram, context, start, count = (np.concatenate(column) for column in zip(*parts, strict=True))
        return gram.view(np.int64), context.view(np.int64), start, count

    def _block(self, data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of_byte, up, down = self.tables
        array = np.frombuffer(data, np.uint8)
        sums = np.zeros(len(array) + 1, np.uint64)
        np.cumsum(of_byte[array] * up[: len(array)], out=sums[1:])
        grams = (sums[self.gram :] - sums[: -self.gram]) * down[: len(array) - self.gram + 1]
        grams ^= grams >> np.uint64(31)
        grams *= _MIX
        grams ^= grams >> np.uint64(29)
        low = np.uint64((1 << 18) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, have = self.length - self.gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: have - width], least[width - have :])
        owner = (least & low).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.append(start, len(owner)))
        owner = owner[start]
        context = (sums[start + count + self.length - 1] - sums[start]) * down[start]
        context = (context ^ (context >> np.uint64(32))) * _MIX + (owner - start).astype(np.uint64) * np.uint64(
            _BASE
        ) + count.astype(np.uint64)
        return grams[owner], context, start + at, count


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Start places of all suffixes, sorted by their first ``depth`` symbols at least.

    Symbols are positive and below 2^21, as is their number.
    """
    n = len(symbols)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    if not len(sample):
        return np.arange(n)
    triples = (s[sample] << 42) | (s[sample + 1] << 21) | s[sample + 2]
    order = np.argsort(triples)
    ranked = triples[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    if names.max() < len(sample) and depth > 3:
        # Names of places 1, 4, 7, ... then of 2, 5, 8, ...; a name says three symbols.
        order = suffix_order(names, -(-depth // 3))
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((s[rest] << 22) | rank[rest + 1])]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    # Below ``depth`` the order of sampled suffixes may be any, so their keys are sorted again.
    before = np.searchsorted(np.sort((s[ones] << 22) | rank[ones + 1]), (s[rest] << 22) | rank[rest + 1])
    before += np.searchsorted(
        np.sort((s[twos] << 43) | (s[twos + 1] << 22) | rank[twos + 2]),
        (s[rest] << 43) | (s[rest + 1] << 22) | rank[rest + 2],
    )
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place], out[~taken] = rest, sample
    return out


def repeated(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For every string of the contexts, in order: the first string that equals it.

    The contexts come in the order in which strings count as earlier; a string that equals
    none before is its own first.
    """
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + bytes(length + 8), np.uint8)
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    counts = sizes - length + 1
    places = np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    n = int(sizes.sum() + len(sizes) - 1)
    number = np.full(n, -1, np.int64)
    number[places] = np.arange(len(places))
    order = suffix_order(text[:n].astype(np.int64) + 1, length)
    order = order[number[order] >= 0]
    words = np.lib.stride_tricks.as_strided(text[: len(text) - 7].view(), (len(text) - 7, 8), (1, 1))
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        word = np.ascontiguousarray(words[order + at]).view(np.uint64).ravel()
        same &= word[1:] == word[:-1]
    group = np.cumsum(np.append(True, ~same)) - 1
    found = number[order]
    first = np.full(group[-1] + 1, len(places), np.int64)
    np.minimum.at(first, group, found)
    out = np.empty(len(places), np.int64)
    out[found] = first[group]
    return out


_ROW = ["gram", "context", "doc", "tie", "start", "count"]
_SCHEMA = "gram long, context long, doc long, tie long, start int, count int, gone boolean"


def _later(frame: pd.DataFrame) -> np.ndarray:
    """Of rows in sorted order: whether the row before is the same context."""
    same = np.zeros(len(frame), bool)
    if len(frame) > 1:
        key = frame[["gram", "context"]].to_numpy(np.int64)
        same[1:] = (key[1:] == key[:-1]).all(axis=1)
    return same


def _combined(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one batch: those that another row of the batch precedes are gone already."""
    frame = frame.sort_values(_ROW, kind="stable", ignore_index=True)
    return frame.assign(gone=_later(frame))


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by gram and context: repeats are gone, contexts alone with their gram pass.

    Rows that come in as gone go through. Out come gone rows, and contexts that share their gram
    with a different one. Two contexts are held at a time.
    """
    held: pd.DataFrame | None = None
    last: tuple[int, int] | None = None  # gram and context of the row before
    shared = False  # whether the gram of ``held`` has been seen with another context
    for batch in batches:
        gone = batch["gone"].to_numpy(bool)
        if gone.any():
            yield batch[gone]
        rows = batch[~gone].reset_index(drop=True)
        if not len(rows):
            continue
        same = _later(rows)
        gram, context = rows["gram"].to_numpy(np.int64), rows["context"].to_numpy(np.int64)
        same[0] = last == (gram[0], context[0])
        last = (gram[-1], context[-1])
        if same.any():
            yield rows[same].assign(gone=True)
        fresh = rows[~same]
        if held is not None:
            fresh = pd.concat([held, fresh])
        if not len(fresh):
            continue
        gram = fresh["gram"].to_numpy(np.int64)
        near = gram[1:] == gram[:-1]
        several = np.append(False, near) | np.append(near, False)
        several[0] |= shared
        if len(fresh) > 1:
            yield fresh[:-1][several[:-1]]
            shared = bool(several[-1])
        held = fresh[-1:]
    if held is not None and shared:
        yield held


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as runs (first, length)."""
    cut = np.flatnonzero(np.append(True, places[1:] != places[:-1] + 1)) if len(places) else np.zeros(0, int)
    return places[cut], np.diff(np.append(cut, len(places)))


def repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, label: str = "suffixes") -> DataFrame:
    """``docs(key, text)`` with ``gone``: (start, end) of the bytes to remove, as maximal runs.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    document with a smaller key, or before in the same one. Null keys come first; rows of one
    key are ordered by a hash of their text, and rows equal in both are one document, so each
    gets the same result. Null texts are empty; short texts and empty tables give no runs.
    """
    spark = docs.sparkSession
    twice = not docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = docs.select(
        key,
        F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("doc"),
        (F.xxhash64("text") if twice else F.lit(0)).cast("long").alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    place = ["doc", "tie"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Anchors(length)
        for batch in batches:
            found = [finder.of(t.encode("utf-8", "replace")) for t in batch["text"]]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                gram, context, start, count = (np.concatenate(c) for c in zip(*found, strict=True))
                yield _combined(
                    pd.DataFrame(
                        {
                            "gram": gram,
                            "context": context,
                            "doc": np.repeat(batch["doc"].to_numpy(), sizes),
                            "tie": np.repeat(batch["tie"].to_numpy(), sizes),
                            "start": start,
                            "count": count,
                        }
                    )
                )

    def dealt(contexts: DataFrame) -> DataFrame:
        # Rows that are gone already only pass by: they are spread, not dealt by their gram.
        spread = F.when(F.col("gone"), F.xxhash64("doc", "start")).otherwise(F.col("gram"))
        return contexts.repartition(spread).sortWithinPartitions(*_ROW).mapInPandas(_resolve, _SCHEMA)

    unique = rows.select("doc", "tie", "text").dropDuplicates(place) if twice else rows
    resolved = staged(dealt(unique.select("doc", "tie", "text").mapInPandas(cut, _SCHEMA)), label)
    release(spark)
    shared = resolved.where("not gone").select(*_ROW)
    counts = shared.groupBy("gram").agg(F.count("*").alias("contexts"))
    crowd = counts.where(F.col("contexts") > GRAM_CONTEXTS).select("gram", F.lit(True).alias("crowded"))
    busy = staged(crowd, label)
    if busy.count() <= BROADCAST_GRAMS:
        busy = F.broadcast(busy)
    sized = shared.join(busy, "gram", "left").select(
        *place, F.struct("gram", "start", "count", F.coalesce("crowded", F.lit(False)).alias("busy")).alias("c")
    )
    # Parallel arrays reach Python as numpy arrays, not as an object per context.
    wanted = sized.groupBy(*place).agg(F.collect_list("c").alias("c")).select(
        *place, *[F.col(f"c.{name}").alias(name) for name in ("gram", "start", "count", "busy")]
    )

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sizes = part["start"].map(len)
                data = []
                for text, starts, counts in zip(part["text"], part["start"], part["count"], strict=True):
                    whole = text.encode("utf-8", "replace")
                    data += [whole[a : a + n + length - 1] for a, n in zip(starts, counts, strict=True)]
                flat = {name: np.concatenate(part[name].tolist()) for name in ("gram", "start", "busy")}
                own = {name: np.repeat(part[name].to_numpy(), sizes) for name in place}
                yield pd.DataFrame({**flat, **own, "data": data})[["gram", *place, "start", "busy", "data"]]

    texts = staged(
        unique.select("doc", "tie", "text")
        .join(wanted, place)
        .mapInPandas(fetch, "gram long, doc long, tie long, start int, busy boolean, data binary"),
        label,
    )
    release(spark)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Contexts of whole grams, a chunk at a time."""
        for frame, bounds in whole_chunks(batches):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = frame.iloc[lo:hi].sort_values(["doc", "tie", "start"], kind="stable")
                contexts = part["data"].tolist()
                first = repeated(contexts, length)
                counts = np.array([len(c) - length + 1 for c in contexts])
                owner = np.repeat(np.arange(len(part)), counts)
                offset = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts)
                late = np.flatnonzero(first != np.arange(len(first)))
                at = owner[late] * (1 << 32) + part["start"].to_numpy(np.int64)[owner[late]] + offset[late]
                start, count = _runs(at)
                row = start >> 32
                yield pd.DataFrame(
                    {
                        "doc": part["doc"].to_numpy()[row],
                        "tie": part["tie"].to_numpy()[row],
                        "start": start & 0xFFFFFFFF,
                        "count": count,
                    }
                )

    ranges = "doc long, tie long, start int, count int"
    quiet = texts.where("not busy").select("gram", *place, "start", "data")
    sorted_out = (
        quiet.repartition("gram").sortWithinPartitions("gram").mapInPandas(sort, ranges)
    )

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every string of the contexts on its own, by a 128-bit hash."""
        for batch in batches:
            for at in range(0, len(batch), 512):
                out = []
                part = batch[["doc", "tie", "start", "data"]].iloc[at : at + 512]
                for doc, tie, start, data in part.itertuples(index=False):
                    for n, window in enumerate(sliding_window_view(np.frombuffer(data, np.uint8), length)):
                        both = xxhash.xxh3_128_digest(window.tobytes())
                        out.append((both, doc, tie, start + n))
                halves = np.frombuffer(b"".join(o[0] for o in out), np.int64).reshape(-1, 2)
                rest = np.array([o[1:] for o in out], np.int64).reshape(-1, 3)
                yield _combined(
                    pd.DataFrame(
                        {
                            "gram": halves[:, 0],
                            "context": halves[:, 1],
                            "doc": rest[:, 0],
                            "tie": rest[:, 1],
                            "start": rest[:, 2],
                            "count": 1,
                        }
                    )
                )

    crowded = dealt(texts.where("busy").select(*place, "start", "data").mapInPandas(strings, _SCHEMA))
    ours = [*place, "start", "count"]
    gone = resolved.where("gone").select(*ours).unionAll(sorted_out).unionAll(crowded.where("gone").select(*ours))
    listed = gone.groupBy(*place).agg(F.collect_list(F.struct("start", "count")).alias("ranges"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def merged(starts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for start, count in zip(starts, counts, strict=True):
            order = np.argsort(start, kind="stable")
            start, end = start[order], (start + count + length - 1)[order]
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            stop = reach[np.append(new[1:], len(start)) - 1]
            out.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), stop.tolist(), strict=True)])
        return pd.Series(out)

    runs = listed.select(*place, merged("ranges.start", "ranges.count").alias("gone"))
    return rows.join(runs, place, "left").select(key, "text", F.coalesce("gone", F.array()).alias("gone"))


def whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by gram, cut where a gram ends and a chunk is full."""
    held: list[pd.DataFrame] = []
    size = 0

    def bounds(frame: pd.DataFrame) -> np.ndarray:
        gram = frame["gram"].to_numpy(np.int64)
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        total = np.cumsum(frame["data"].map(len).to_numpy() + 1)[ends - 1]
        cuts, start = [0], 0
        for end, reach in zip(ends.tolist(), total.tolist(), strict=True):
            if reach - start >= CHUNK:
                cuts.append(end)
                start = reach
        return np.array(cuts)

    for batch in batches:
        held.append(batch)
        size += int(batch["data"].map(len).sum())
        if size >= 2 * CHUNK:
            frame = pd.concat(held, ignore_index=True)
            cuts = bounds(frame)
            # The last gram may go on, so its chunk waits.
            cuts = cuts[cuts < len(frame)]
            yield frame, cuts
            held, size = [frame.iloc[cuts[-1] :]], 0
    if held:
        frame = pd.concat(held, ignore_index=True)
        if len(frame):
            cuts = bounds(frame)
            yield frame, cuts if cuts[-1] == len(frame) else np.append(cuts, len(frame))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, start, end in zip(texts, starts, ends, strict=True):
            data, digest, at = text.encode("utf-8", "replace"), hashlib.sha256(), 0
            for a, b in zip(start, end, strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append(digest.hexdigest())
        return pd.Series(out)

    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return repeats(docs).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("gone").cast("long").alias("n_spans"),
        kept("text", "gone.start", "gone.end").alias("kept_sha256"),
    )
