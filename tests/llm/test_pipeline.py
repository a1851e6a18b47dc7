"""The corpus pipeline against a plain version of its stages."""

import hashlib
import re

import corpus_pipeline
from eventrail.llm import bpe, neighbours
from eventrail.llm.common import table
from tests.llm.frames import awkward, rows_of
from tests.llm.test_brute_force import plain_components
from tests.llm.test_shingles import plain_set

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The patterns of the base kinds, their lengths, and those of the added kinds.
SECRETS = (
    (r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def masked(text):
    gone = sorted(
        m.span() for p, group, least in SECRETS for m in re.finditer(p, text) if len(m[group]) >= least
    )
    out, at = "", 0
    for start, end in gone:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def plain(spark, folder):
    docs = table(spark, folder, "documents")
    model = neighbours.fit(docs, table(spark, folder, "labels"))
    rows = docs.orderBy("doc_id").collect()
    scores = model.scores([r["text"] for r in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    sets = [plain_set(r["text"]) for r in kept]
    parts = plain_components(
        [r["doc_id"] for r in kept], lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    )
    kept = [r for r, p in zip(kept, parts, strict=True) if r["doc_id"] == p]
    grams = set()
    for item in table(spark, folder, "benchmark").collect():
        w = words(item["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    clean = []
    for r in kept:
        w = words(r["text"])
        if not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1)):
            clean.append(r)
    coder = bpe.Coder(bpe.ranks_file(), bpe.public_tokenizers.PATTERN)
    out = []
    for r in clean:
        text = masked(r["text"] or "")
        ids = coder.plain(text)
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out.append((r["doc_id"], len(ids), listed, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pipeline_against_plain_stages(spark, sample):
    found = corpus_pipeline.run(spark, sample)
    want = plain(spark, sample)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert 0 < len(want) < table(spark, sample, "documents").count()


def test_stages_keep_columns_and_take_awkward_rows(spark, sample, folder_of):
    labels = table(spark, sample, "labels")
    benchmark = table(spark, sample, "benchmark")
    folder = folder_of(labels=labels, benchmark=benchmark)
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert last.count() == docs.count()


def test_one_document_of_a_group_stays(spark, folder_of):
    kept = corpus_pipeline.near_duplicates(spark, awkward(spark), "")
    rows = kept.collect()
    # 3, 4 and 8 have no words, 5 and 6 the same text, 1 is there twice.
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 3, 4, 5, 6, 8)) == [1, 3, 5]
