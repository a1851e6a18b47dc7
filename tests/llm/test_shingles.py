"""Near-duplicates by shingles against all pairs."""

import numpy as np

import corpus_pipeline
from eventrail.llm import shingles, simhash
from eventrail.llm.common import table
from tests.llm.frames import awkward, rows_of
from tests.llm.test_brute_force import plain_components


def plain_set(text):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - 4) if words else 0
    return {b" ".join(words[i : i + 5]) for i in range(n)}


def want(docs):
    sets = [plain_set(t) for _, t in docs]

    def near(x, y):
        return len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])

    return sorted(zip([k for k, _ in docs], plain_components([k for k, _ in docs], near), strict=True), key=repr)


def test_all_similar_texts_link(spark, sample):
    """Small and large changes around the threshold, a crowded group in several blocks, real texts."""
    rng = np.random.default_rng(3)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sample, "documents").collect()]
    docs += [(r["doc_id"], r["text"]) for r in awkward(spark).collect() if r["doc_id"] is not None]
    for n in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, 120))]
        docs.append((100_000 + n, " ".join(base)))
        for k in range(3):
            other = list(base)
            for _ in range(k + 1):
                other[rng.integers(len(other))] = f"z{rng.integers(9)}"
            docs.append((200_000 + 3 * n + k, " ".join(other)))
    crowd = [f"c{x}" for x in range(150)]
    for n in range(40):
        docs.append((300_000 + n, " ".join([*crowd[:n], f"x{n}", *crowd[n:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(shingles.near_duplicates(df, block=8), "doc_id", "component_id") == want(docs)


def test_stage_drops_near_copies_far_in_bits(spark):
    """Two changed words of 120: over four fifths in common, far over 3 bits apart."""
    words = [f"w{n}" for n in range(120)]
    near = [w if n not in (3, 60) else "other" for n, w in enumerate(words)]
    far = [w if n % 6 else "other" for n, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_families_around_the_threshold(spark):
    """Families whose members lie on both sides of the threshold, so that pivots see them partly."""
    rng = np.random.default_rng(9)
    docs = []
    for family in range(6):
        base = [f"f{family}w{x}" for x in range(100)]
        for n in range(30):
            other = list(base)
            for at in rng.integers(0, 100, rng.integers(0, 9)):
                other[at] = f"{family} {n}" if n % 2 else f"common{at % 3}"
            docs.append((1000 * family + n, " ".join(other)))
    # Chains: each text keeps most of the one before, and little of the first.
    for n in range(40):
        docs.append((9000 + n, " ".join(f"chain{x}" for x in range(2 * n, 2 * n + 60))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(shingles.near_duplicates(df, block=4), "doc_id", "component_id") == want(docs)


def passages(count):
    """Texts that are mostly one passage, none similar to another, and near copies of every tenth."""
    passage = [f"p{x}" for x in range(40)]
    docs = [(n, " ".join([f"own{n}", f"more{n}", *passage, f"last{n}"])) for n in range(count)]
    docs += [(10_000 + n, f"{text} again") for n, text in docs if n % 10 == 0]
    return docs + [(20_000 + n, " ".join(f"chain{x}" for x in range(2 * n, 2 * n + 60))) for n in range(count // 4)]


def test_few_pairs_of_a_group_are_compared(spark, monkeypatch):
    """Sketches tell the members of a large group apart, so that whole sets seldom meet."""
    docs, compared, pairs = passages(120), shingles._compared, []

    def counted(found, *rest):
        pairs.append(found.count())
        return compared(found, *rest)

    monkeypatch.setattr(shingles, "_compared", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(shingles.near_duplicates(df), "doc_id", "component_id") == want(docs)
    assert 0 < sum(pairs) < 2 * len(docs)


def test_groups_in_many_cells(spark):
    """Blocks of the largest component, of the rest, and cells that hold one row."""
    docs = passages(60)
    crowd = [f"c{x}" for x in range(150)]
    docs += [(30_000 + n, " ".join([*crowd[:n], f"x{n % 9}", *crowd[n:]])) for n in range(40)]
    docs += [(40_000 + n, " ".join([*crowd[: 140 - 2 * n], *(f"y{n} {x}" for x in range(n))])) for n in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for cell in (2, 6):
        assert rows_of(shingles.near_duplicates(df, block=4, cell=cell), "doc_id", "component_id") == want(docs)


def test_tasks_take_no_module_along(spark):
    """The module of fingerprints holds a function that, once used, is tied to the session."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 3
    assert rows_of(shingles.near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]
