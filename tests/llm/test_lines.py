"""Line dedup: the filter, insertions and deletions against an index made at once."""

import hashlib

import numpy as np
import pytest

from eventrail.llm import lines
from tests.llm.frames import awkward, rows_of


def plain(docs, least=3):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows."""
    holders = {}

    def key(line):
        cut = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in cut)

    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            held = holders.get(key(line), ())
            last = max((d for d in held if d is not None), default=None)
            if len(held) < least or doc == last:
                kept.append(line)
        n = len((text or "").split("\n"))
        out.append((doc, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(index, df):
    return rows_of(lines.dedup(index, df), "doc_id", "dedup.n_lines", "dedup.n_dropped", "dedup.kept")


def made(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def some(rng, ids):
    pool = [f"This line of the pool has number {n}" for n in range(25)] + ["short", "", "  ", "Ä" * 20]
    out = []
    for doc in ids:
        picked = [pool[x] for x in rng.integers(0, len(pool), rng.integers(0, 9))]
        picked += [f"a line that only document {doc} has"]
        out.append((int(doc), "\n".join(l.upper() if rng.random() < 0.2 else f"\t{l} \r" for l in picked)))
    return out


def test_filter_forgets_and_never_misses():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 40_000, dtype=np.int64)
    held = lines.CuckooFilter.sized(len(keys))
    assert held.insert(keys[:30_000].copy())
    assert held.holds(keys[:30_000]).all()
    assert held.holds(keys[30_000:]).mean() < 0.01
    held.delete(keys[:15_000])
    held = lines.CuckooFilter.read(held.data())
    assert held.holds(keys[15_000:30_000]).all() and held.holds(keys[:15_000]).mean() < 0.01
    held.delete(keys[15_000:30_000])
    assert not held.buckets.any()


def test_filter_of_equal_prints_and_overflow():
    keys = np.full(8, 12345 << 48, np.int64)
    held = lines.CuckooFilter.sized(8)
    assert held.insert(keys) and not lines.CuckooFilter.sized(8).insert(np.full(9, 12345 << 48, np.int64))
    held.delete(keys[:7])
    assert held.holds(keys[:1]).all()
    held.delete(keys[:1])
    assert not held.holds(keys[:1]).any()


def test_changes_equal_an_index_made_at_once(spark):
    rng = np.random.default_rng(2)
    first, second = some(rng, range(60)), some(rng, range(60, 100))
    second += [(None, first[0][1]), (None, first[1][1])]
    index = lines.build(made(spark, first))
    assert found(index, made(spark, first)) == plain(first)
    index = lines.insert(index, made(spark, second))
    index = lines.insert(index, made(spark, second[:10]))  # nothing new
    assert found(index, made(spark, first + second)) == plain(first + second)
    gone = {d for d, _ in second} | set(range(0, 60, 3))
    index = lines.delete(index, made(spark, [(d, None) for d in gone] + [(9999, None)]))
    left = [r for r in first if r[0] not in gone]
    assert found(index, made(spark, left)) == plain(left)
    again = lines.build(made(spark, left))
    assert rows_of(index.counts, "k1", "k2", "docs", "last") == rows_of(again.counts, "k1", "k2", "docs", "last")
    index = lines.delete(index, made(spark, left))
    assert index.refs.isEmpty() and index.counts.isEmpty()
    assert not any(np.frombuffer(r["data"], "<u2").any() for r in index.filters.collect())


def test_full_filters_are_built_anew(spark, monkeypatch):
    keys = [f"line number {n} that three documents hold" for n in range(9000)]
    docs = [(d, "\n".join(keys)) for d in range(3)]
    index = lines.insert(lines.build(made(spark, docs[:1])), made(spark, docs[1:]))
    assert found(index, made(spark, docs)) == plain(docs)
    monkeypatch.setattr(lines, "SHARD_KEYS", 200)
    index = lines.build(made(spark, docs))
    assert index.shards == 45
    assert found(index, made(spark, docs)) == plain(docs)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("dedup", lines.F.lit(1)).withColumn("row", lines.F.lit("r"))
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    docs += [(n, "One Line in every document\n\n" + "x" * 30) for n in (20, 21, 22, 22, None)]
    more = made(spark, docs[-5:])
    whole = df.unionByName(more, allowMissingColumns=True)
    out = lines.dedup(lines.build(whole), whole)
    assert out.columns == [c for c in df.columns if c != "dedup"] + ["dedup"]
    assert rows_of(out, "doc_id", "dedup.n_lines", "dedup.n_dropped", "dedup.kept") == plain(docs)
    empty = df.limit(0)
    assert lines.dedup(lines.build(empty), empty).isEmpty()
    assert not lines.dedup(lines.build(empty), df).where("dedup.n_dropped > 0").count()


@pytest.mark.parametrize("text", ["\n", "a\n\nb\n", "\r\n", " x"])
def test_lines_end_at_line_feeds_only(spark, text):
    got = lines.dedup(lines.build(made(spark, [(1, text)])), made(spark, [(1, text)])).first()["dedup"]
    assert (got["n_lines"], got["kept"]) == (text.count("\n") + 1, text)
    assert hashlib.sha256(got["kept"].encode()).hexdigest()
