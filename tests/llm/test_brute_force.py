"""Queries that SQL cannot express, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

from eventrail.llm import bpe, neighbours, repair
from eventrail.llm.common import components, table
from eventrail.llm.queries import QUERIES
from tests.llm.frames import awkward, rows_of


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, folder, "documents").collect()]


def test_shards(spark, sample):
    docs = {r["doc_id"]: r for r in table(spark, sample, "documents").collect()}
    rows = QUERIES["op2_interleave"](spark, sample).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        shards.setdefault(r["shard"], []).append((r["slot"], docs[r["doc_id"]]["source"]))
    assert sorted(shards) == list(range(40))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slot for slot, _ in s) == list(range(len(s))) for s in shards.values())
    # Every stretch of shards holds each source in proportion, up to one row at either end.
    order = [source for n in range(40) for _, source in sorted(shards[n])]
    for source in set(order):
        seen = np.cumsum([s == source for s in order])
        share = seen[-1] / len(order) * np.arange(1, len(order) + 1)
        assert np.abs(seen - share).max() <= 1.01


def test_shards_of_awkward_rows(spark, folder_of):
    folder = folder_of(documents=awkward(spark))
    rows = QUERIES["op2_interleave"](spark, folder).collect()
    assert len(rows) == 11 and len({(r["shard"], r["slot"]) for r in rows}) == 11


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if len(words) < 3:
        shingles = [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, near):
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(keys)):
        for y in range(x):
            if near(x, y):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    named = {}
    for x in range(len(keys)):
        if keys[x] is not None:
            named[root(x)] = min(named.get(root(x), keys[x]), keys[x])
    return [named.get(root(x)) for x in range(len(keys))]


def check_simhash(spark, folder):
    docs = texts(spark, folder)
    codes = [plain_fingerprint(t) for _, t in docs]
    parts = plain_components([k for k, _ in docs], lambda x, y: (codes[x] ^ codes[y]).bit_count() <= 3)
    want = [(k, f"{c:016x}", p) for (k, _), c, p in zip(docs, codes, parts, strict=True)]
    found = QUERIES["op7_simhash"](spark, folder)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_simhash(spark, sample):
    check_simhash(spark, sample)


def test_simhash_of_awkward_rows(spark, folder_of):
    check_simhash(spark, folder_of(documents=awkward(spark)))


def test_simhash_trees_of_a_crowded_bucket(spark):
    """A bucket above the bound is cut into several trees without losing a link."""
    from eventrail.llm.simhash import linked

    rng = np.random.default_rng(4)
    codes = {0}
    while len(codes) < 150:  # a cloud of near codes, and some far ones
        base = int(rng.choice(list(codes)))
        codes.add(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    codes |= {int(c) for c in rng.integers(0, 2**63, 50)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    got = {r["node"]: r["component"] for r in linked(df, "test", tree_nodes=8).collect()}
    want = plain_components(signed, lambda x, y: (codes[x] ^ codes[y]).bit_count() <= 3)
    assert [got.get(c, c) for c in signed] == want


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 160)] + [(200, 200), (300, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "test").collect()}
    assert all(got[n] == 0 for n in range(61)) and all(got[n] == 100 for n in range(100, 160))
    assert got[300] == got[201] == 201 and 200 not in got


def check_repeats(spark, folder):
    docs = sorted((r for r in texts(spark, folder)), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), []
    for key, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = QUERIES["op6_suffixes"](spark, folder)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(found, *columns) == sorted(want, key=repr)


def test_repeats(spark, sample):
    check_repeats(spark, sample)


def test_repeats_of_awkward_rows(spark, folder_of):
    check_repeats(spark, folder_of(documents=awkward(spark).where("doc_id is null or doc_id <> 1")))


def test_equal_rows_count_once(spark, folder_of):
    docs = awkward(spark).withColumn("text", __import__("pyspark").sql.functions.repeat("text", 3))
    folder = folder_of(documents=docs.where("doc_id = 1"))
    first, second = QUERIES["op6_suffixes"](spark, folder).collect()
    assert first == second


def test_repeats_in_crowded_grams(spark, folder_of, monkeypatch):
    """Grams with many contexts go string by string; the result is the same."""
    from eventrail.llm import suffixes

    monkeypatch.setattr(suffixes, "GRAM_CONTEXTS", 1)
    rng = np.random.default_rng(8)
    line = "".join(rng.choice(list("abcdef "), 300))
    docs = [(n, "".join(rng.choice(list("xyz "), 40)) + line[: 120 + 7 * n] + str(n) * 50) for n in range(20)]
    check_repeats(spark, folder_of(documents=spark.createDataFrame(docs, "doc_id long, text string")))


def test_suffix_order():
    from eventrail.llm.suffixes import repeated, suffix_order

    rng = np.random.default_rng(2)
    for _ in range(300):
        symbols = rng.integers(1, rng.integers(2, 20), rng.integers(1, 70))
        full = suffix_order(symbols, 1000).tolist()
        assert full == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        depth = int(rng.integers(1, 12))
        short = [symbols[i : i + depth].tolist() for i in suffix_order(symbols, depth)]
        assert short == sorted(short)
        contexts = [bytes(rng.integers(97, 99, rng.integers(8, 30)).tolist()) for _ in range(5)]
        strings = [c[i : i + 8] for c in contexts for i in range(len(c) - 7)]
        assert repeated(contexts, 8).tolist() == [strings.index(s) for s in strings]


def check_bpe(spark, folder):
    pairs = map(bytes.split, bpe.ranks_file().splitlines())
    import base64

    ranks = {base64.b64decode(t): int(n) for t, n in pairs}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, text in texts(spark, folder):
        ids = plain.encode_ordinary(text)
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((key, len(ids), listed, hashlib.sha256(text.encode()).hexdigest()))
    found = QUERIES["op8_bpe"](spark, folder)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe(spark, sample):
    check_bpe(spark, sample)


def test_bpe_of_awkward_rows(spark, folder_of):
    check_bpe(spark, folder_of(documents=awkward(spark)))


def test_bpe_joins_any_leaves():
    rng = np.random.default_rng(6)
    letters = list("aab'sStre  \n\n\t\x1c\x85   é1!.$漢\U0001f600ß́")
    whole = bpe.Coder(bpe.ranks_file(), public_tokenizers.PATTERN, 1 << 20)
    for leaf in (1, 2, 3, 7):
        coder = bpe.Coder(bpe.ranks_file(), public_tokenizers.PATTERN, leaf)
        for _ in range(150):
            text = "".join(rng.choice(letters, rng.integers(0, 60)))
            ids = coder.encode(text)
            assert ids == whole.encode(text) and coder.decode(ids) == text.encode()


def test_bpe_columns(spark):
    docs = spark.createDataFrame([("a b\n c" * 3000,), (None,), ("",)], "text string")
    coded = docs.withColumn("ids", bpe.encoded(docs["text"], spark))
    back = coded.select("text", bpe.decoded(coded["ids"], spark).alias("data")).collect()
    assert [bytes(r["data"]).decode() for r in back] == [r["text"] or "" for r in back]


def check_grammars(spark, folder):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for key, text in sorted(texts(spark, folder), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = QUERIES["op4_repair"](spark, folder)
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_grammars(spark, sample):
    check_grammars(spark, sample)


def test_grammars_of_awkward_rows(spark, folder_of):
    check_grammars(spark, folder_of(documents=awkward(spark)))


def test_word_encoder_agrees_with_the_tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    plain, words = Tokenizer.from_str(vocabulary), repair.WordEncoder(vocabulary)
    rng = np.random.default_rng(5)
    letters = list("aAbB'sSt.,!?;: \n\t\x1c\x85 é́İıßſKΣσ12½²漢\U0001f600-_<>|#̸​")
    for _ in range(200):
        batch = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(10)]
        for text, ids in zip(batch, words.encode(batch), strict=True):
            assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_word_encoder_keeps_marks_capitals_and_added_tokens():
    """Letters that normalize to a letter and a mark, capitals that compose otherwise, added tokens."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    plain, words = Tokenizer.from_str(vocabulary), repair.WordEncoder(vocabulary)
    cases = ["\u092a\u0939\u093e\u095c. x", "\u05d0\ufb1d!", "<|ENDOFTEXT|> <|EndOfText|>", "A<|endoftext|>B."]
    cases += ["H\u0331a", "xT\u0308. y", "Y\u030a", "<|endoftext|>.", "Stra\u00dfe. \u0421\u043b\u043e\u0432\u043e."]
    starts = [n for n in range(0xA0, 0x20000) if chr(n).isalpha() and not 0x3400 <= n < 0xD7A4]
    cases += [f"a{chr(n)}." for n in starts]
    for text, ids in zip(cases, words.encode(cases), strict=True):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], ascii(text)


def test_word_encoder_forgets_and_learns_again():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    plain, words = Tokenizer.from_str(vocabulary), repair.WordEncoder(vocabulary, cache_words=60)
    rng = np.random.default_rng(6)
    for _ in range(40):
        batch = [" ".join(f"Word{x}," if x % 3 else f"w\u00e9{x}" for x in rng.zipf(1.2, 30) % 500) for _ in range(3)]
        batch += [None, "", "  ", " the a the "]
        for text, ids in zip(batch, words.encode(batch), strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    assert words.encode([]) == [] and len(words.slots) < 400


def test_rows_of_one_key_have_a_fixed_order(spark, tmp_path):
    rows = [(n % 2 or None, f"text number {n}") for n in range(300)] + [(5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n, parts in enumerate((1, 7)):
        repair.write(df.repartition(parts), f"{tmp_path}/{n}", shard_ids=100)
        found.append(rows_of(repair.read(spark, f"{tmp_path}/{n}"), "doc_id", "start", "n_tokens", "ids_crc32"))
    assert found[0] == found[1]
    starts = [r[1] for r in sorted(found[0], key=lambda r: r[1])]
    keys = [r[0] for r in sorted(found[0], key=lambda r: r[1])]
    assert len(set(starts)) == 302 and keys == [None] * 150 + [1] * 150 + [5] * 2


def test_rounds_go_on_after_an_idle_one():
    """A pair may lose its hash slot in one round; the grammar goes on with another hash."""
    ids = np.tile(np.arange(40, dtype=np.uint32), 300)
    rules, symbols = repair.compress(ids, 40)
    assert len(symbols) < 600 and len(rules) < 200


def test_containers_decode_any_stretch():
    rng = np.random.default_rng(9)
    for ids in (
        np.full(5000, 7, np.uint32),
        rng.integers(0, 4, 20000).astype(np.uint32),
        np.tile(rng.integers(0, 49408, 50), 400).astype(np.uint32),
        rng.integers(0, 2**31, 100).astype(np.uint32),
        np.ones(1, np.uint32),
    ):
        box = repair.Container(repair.pack([None, 5], [1, len(ids) - 1], ids, frequent=8))
        assert box.keys == [None, 5] and (box.ids() == ids).all()
        assert int(box.ends[-1]) == len(ids)
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (box.ids(int(a), int(b)) == ids[a:b]).all()
    assert len(repair.compress(np.full(5000, 7, np.uint32), 8, 8)[1]) < 100


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    rows = QUERIES["op9_neighbours"](spark, folder).collect()
    assert len(rows) == table(spark, folder, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in known if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in known if labels[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean(np.array(good) >= 0.3) > 0.97


def test_scores_are_the_vote_of_all_cosines():
    """The blocked products against a plain loop over every labelled vector."""
    rng = np.random.default_rng(1)
    samples = [" ".join(rng.choice(["foo", "Bar", "baz!!", "qu 1"], 30)) for _ in range(40)]
    raw = np.stack([neighbours.features(t) for t in samples])
    projection = neighbours._latent(neighbours._unit(raw), 8)
    labels = rng.integers(0, 2, 40).astype(float)
    model = neighbours.Model(projection, neighbours._unit(raw @ projection), labels, float(labels.mean()))
    got = model.scores([*samples[:5], "", None])
    for n in range(5):
        own = neighbours._unit((raw[n] @ projection)[None])[0]
        cosine = sorted(((float(own @ v), y) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)[:25]
        vote = sum(max(c, 0) ** 2 * y for c, y in cosine) / sum(max(c, 0) ** 2 for c, _ in cosine)
        assert abs(got[n] - vote) < 1e-4
    assert got[5] == got[6] == model.prior


def test_classifier_of_awkward_rows(spark, folder_of):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (4, 0, 0), (7, 0, None), (None, 1, 0), (9, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    folder = folder_of(documents=awkward(spark), labels=labels)
    rows = QUERIES["op9_neighbours"](spark, folder).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)


def test_projection_recall_and_dense_groups(spark, folder_of):
    """Planted pairs around the threshold, and a group with more links than any window lists."""
    rng = np.random.default_rng(12)
    vectors = rng.standard_normal((900, 64)).astype(np.float32)
    vectors[:300] = vectors[0] + 0.1 * rng.standard_normal((300, 64))  # one dense group
    for n in range(300, 600):  # near pairs of varying closeness
        vectors[n] = vectors[n + 300] + rng.uniform(0.05, 0.45) * rng.standard_normal(64)
    rows = [(n, v.tolist(), 1) for n, v in enumerate(vectors)]
    folder = folder_of(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op10_projections"](spark, folder).collect()}
    counts = np.array([got[n] for n in range(900)])
    assert (counts <= close.sum(1)).all()
    assert (counts[:300] == close.sum(1)[:300]).all()
    assert counts.sum() >= 0.95 * close.sum()
