"""Ranked search: skipping against scoring every document."""

import math
import re
from collections import Counter

import numpy as np

from eventrail.llm import ranked
from eventrail.llm.common import table
from tests.llm.frames import awkward

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    full, words = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, bag in bags:
            score = 0
            for t, times in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * full + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * sum(bag.values()) * full) // words
                    score += times * w * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, unnamed, doc) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if unnamed else doc, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_awkward_rows_in_small_blocks(spark):
    docs = awkward(spark).withColumn("rank", ranked.F.lit("x")).withColumn("score", ranked.F.lit(1))
    items = [
        (1, "alpha BETA beta, gamma-delta kappa"), (1, "omicron"), (2, None), (3, ""), (4, "?!"), (None, "tau one"),
        (5, "nowhere"), (6, "alpha " * 40 + "17 18 19 one token"), (6, "hunter2hunter2"), (7, "password 1 2 3 4 5"),
    ]
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", ranked.F.lit(3))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert found(ranked.search(docs, asked, block_docs=3)) == want
    assert found(ranked.search(docs, asked, query_bytes=40)) == want
    assert ranked.search(docs.limit(0), asked).isEmpty()
    assert ranked.search(docs, asked.limit(0)).isEmpty()


def test_ties_and_copies(spark):
    docs = [(n, "same words here") for n in range(200, 100, -1)] + [(n, f"same {n}") for n in range(60)]
    items = [(0, "same words"), (1, "words here same same"), (2, "59 same here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = found(ranked.search(df, spark.createDataFrame(items, "item_id long, text string"), block_docs=16))
    assert got == plain(docs, items)


def test_whole_sample_and_what_is_skipped(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sample, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sample, "benchmark").collect()]
    got = ranked.search(table(spark, sample, "documents"), table(spark, sample, "benchmark"), block_docs=32)
    assert found(got) == plain(docs, items)


def test_pair_bounds_hold_and_are_tighter(spark):
    """No document beats the bound of a pair, and rare pairs stay below the sum of their terms."""
    rng = np.random.default_rng(5)
    docs = [(n, " ".join(f"t{x}" for x in rng.zipf(1.3, 60) % 300)) for n in range(400)]
    vocabulary = {f"t{n}".encode(): n for n in range(300)}
    weights = rng.integers(0, 9000, 300)
    queries, pairs = ranked._paired([(0, Counter({n: 1 + n % 3 for n in range(101)}))], weights)
    blocks = ranked.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), vocabulary, 128)
    total = loose = 0
    for row in ranked.impacts(blocks, weights, pairs, 400, 24_000).toPandas().itertuples():
        block, query = ranked.Block(row), queries[0]
        bound = query.bounds(block.most, block.pair_most)
        every = np.arange(len(block.ids))
        for unit in range(len(bound)):
            assert block._added(query, unit, every).max() <= bound[unit]
        own = query.times_left * block.most[query.left]
        own += np.where(query.right >= 0, query.times_right * block.most[query.right], 0)
        total, loose = total + bound.sum(), loose + own.sum()
        at, score = block.search(query, 0)
        least = int(np.sort(score)[-5])
        some, high = block.search(query, least)
        assert dict(zip(some.tolist(), high.tolist(), strict=True)) == {
            a: s for a, s in zip(at.tolist(), score.tolist(), strict=True) if s >= least
        }
    assert total < 0.9 * loose
