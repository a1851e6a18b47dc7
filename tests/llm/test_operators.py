"""Parts of the operators that no registered query reaches."""

from pyspark.sql import functions as F

from eventrail.llm import chat, decontaminate, interleave, secrets
from eventrail.llm.common import numbered
from tests.llm.frames import awkward, rows_of


def test_layouts(spark):
    schema = (
        "conv_id long, prompt string, completion string, system string, instruction string, "
        "input string, output string, messages array<struct<role:string,content:string>>, "
        "conversations array<struct<from:string,value:string>>, note string"
    )
    rows = [
        (1, "q", "a", None, None, None, None, None, None, None),
        (2, "q", "a", "s", None, None, None, None, None, None),
        (3, None, None, None, "i", "x", "o", None, None, None),
        (4, None, None, None, "i", None, "o", None, None, None),
        (5, None, None, None, None, None, None, [("user", "u"), ("tool", None)], None, None),
        (6, None, None, None, None, None, None, None, [("human", "h"), ("gpt", "g")], None),
        (7, "q", None, None, None, None, None, None, None, None),  # answers no layout
        (8, None, None, None, None, None, None, None, None, None),
        (9, "q", "a", None, None, None, None, None, None, "clash"),  # one field too many
        (10, None, None, None, None, None, None, [], None, None),
    ]
    found = chat.canonical(spark.createDataFrame(rows, schema)).orderBy("conv_id").collect()
    assert [r["layout"] for r in found] == [
        "prompt", "guided", "instruction", "instruction", "messages", "shared", None, None, None, None,
    ]
    turns = [[tuple(t) for t in r["turns"]] for r in found]
    assert turns[0] == [("user", "q"), ("assistant", "a")]
    assert turns[2] == [("system", "i"), ("user", "x"), ("assistant", "o")]
    assert turns[3] == [("system", "i"), ("assistant", "o")]
    assert turns[4] == [("user", "u"), ("tool", "")]
    assert turns[5] == [("user", "h"), ("assistant", "g")]
    assert turns[6:] == [[], [], [], []]


def test_fields_that_no_element_fills_do_not_count(spark):
    """Null fields inside arrays, roles or texts that are null throughout, and lists of nulls."""
    schema = (
        "conv_id long, messages array<struct<role:string,content:string,name:string>>, "
        "conversations array<struct<from:string,value:string,weight:int>>"
    )
    rows = [
        (1, [("user", "u", None), ("assistant", "a", None)], None),
        (2, [("user", "u", "n")], None),  # a field that no layout knows
        (3, [("user", None, None)], None),
        (4, [(None, "x", None)], None),
        (5, [(None, None, None)], None),
        (6, [None], None),
        (7, None, [("human", "h", None)]),
        (8, [], [("gpt", None, None), ("human", "x", None)]),
        (9, [("user", "u", None)], [("gpt", "g", None)]),  # two layouts at once
    ]
    found = {r["conv_id"]: r for r in chat.canonical(spark.createDataFrame(rows, schema)).collect()}
    layouts = {1: "messages", 2: None, 3: "messages", 4: "messages", 5: "messages", 6: "messages", 7: "shared",
               8: "shared", 9: None}
    assert {k: r["layout"] for k, r in found.items()} == layouts
    assert [tuple(t) for t in found[1]["turns"]] == [("user", "u"), ("assistant", "a")]
    assert [tuple(t) for t in found[8]["turns"]] == [("assistant", ""), ("user", "x")]
    assert len(found[5]["turns"]) == 1 and found[2]["turns"] == []


def test_no_text_exhausts_a_stack(spark):
    """A million characters that every secret pattern nearly matches, or matches."""
    texts = {
        "pem": "-----BEGIN " + "A " * 500_000 + "PRIVATE KEY-----",
        "open": "-----BEGIN " + "A " * 500_000,
        "assign": "password" + " " * 500_000 + "=" + " " * 10 + "x" * 500_000,
        "words": "secret token api_key " * 50_000,
        "hex": "0123456789abcdef" * 60_000,
        "access": "AKIA" * 250_000,
        "forge": "ghp_" + "z" * 1_000_000,
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    spans = {list(texts)[r["doc_id"]]: r["spans"] for r in secrets.scan(df).collect()}
    assert {k: len(v) for k, v in spans.items()} == {
        "pem": 1, "open": 0, "assign": 1, "words": 0, "hex": 1, "access": 1, "forge": 1,
    }


def test_template_reads_back(spark):
    nasty = ["", "<|im_end|>\n", "\\", "<", "<|", "\\<|", "a\\|b", "<|im_start|>assistant\nx", "\n", "$1 \\1", "\U0001f600"]
    turns = [[(role, text), ("assistant", text + role)] for role in nasty for text in nasty]
    df = spark.createDataFrame([(t,) for t in turns], f"turns {chat.TURNS}")
    done = chat.formatted(df).select("turns", chat.read_back(F.col("formatted")).alias("back"), "formatted", "loss_spans")
    for r in done.collect():
        assert r["back"] == r["turns"]
        assert r["formatted"].count(chat.END) == r["formatted"].count(chat.START) == 2
        trained = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [s.replace("<\\|", "<|").replace("\\\\", "\\") for s in spans if "\\" not in s] == [
            t for t in trained if "\\" not in t and "<|" not in t
        ]


def test_trigram_queries():
    queries = {r.name: secrets.trigram_query(r.pattern) for r in secrets.BASE + secrets.ADDED}
    assert queries["hex"] == []
    assert queries["access"] == [frozenset({frozenset({"aki", "kia"})})]
    assert len(queries["assign"]) == 1 and frozenset({"tok", "oke", "ken"}) in queries["assign"][0]
    assert len(queries["pem"]) == 2
    assert secrets.trigram_query("a.c|xyz") == [] and secrets.trigram_query("(?:abc)?d") == []
    assert secrets.trigram_query("(?:abc)+") == [frozenset({frozenset({"abc"})})]
    assert secrets.trigram_query("ab[cd]e*fgh") == [
        frozenset({frozenset({"abc"}), frozenset({"abd"})}),
        frozenset({frozenset({"fgh"})}),
    ]


def test_secrets_of_awkward_rows(spark):
    found = {r["doc_id"]: r for r in secrets.scan(awkward(spark)).collect()}
    assert [tuple(s) for s in found[None]["spans"]] == [
        (0, 0, "assign", 25), (32, 1, "access", 52),
    ]
    assert [s["name"] for s in found[7]["spans"]] == ["hex"]
    assert found[3]["spans"] == [] and found[4]["spans"] == [] and found[5]["n_chars"] > 100000
    masked = secrets.scan(awkward(spark)).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t"))
    texts = {r["doc_id"]: r["t"] for r in masked.collect()}
    assert texts[None] == "[SECRET] and \U0001f600 [SECRET]"
    assert texts[7] == "[SECRET] token: abc" and texts[3] is None


def test_many_matches_keep_their_places(spark):
    text = "é token=abcdef1 " * 2000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan(df).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(16 * n + 2, 16 * n + 15) for n in range(2000)]


def test_secrets_join_when_candidates_are_many(spark, monkeypatch):
    before = rows_of(secrets.scan(awkward(spark)), "doc_id", "spans")
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    assert rows_of(secrets.scan(awkward(spark)), "doc_id", "spans") == before


def test_benchmark_in_blocks(spark, sample):
    from eventrail.llm.common import table

    docs, items = table(spark, sample, "documents"), table(spark, sample, "benchmark")
    whole = rows_of(decontaminate.contamination(docs, items), "doc_id", "hits")
    parts = rows_of(decontaminate.contamination(docs, items, block_words=150), "doc_id", "hits")
    assert whole == parts


def test_blocks_keep_columns_that_clash(spark):
    docs = awkward(spark).withColumn("hits", F.lit(1)).withColumn("more", F.lit("m"))
    items = spark.createDataFrame([(n, f"alpha beta gamma {n}") for n in range(4)] + [(9, "one")], "item_id long, text string")
    whole = decontaminate.contamination(docs, items)
    parts = decontaminate.contamination(docs, items, block_words=4)
    assert sorted(parts.columns) == sorted(whole.columns) == sorted(docs.columns)
    assert rows_of(whole, "doc_id", "more", "hits") == rows_of(parts, "doc_id", "more", "hits")


def test_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(7)))
    rows = numbered(df, ["k", "id"], "n", "test").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_written_shards(spark, sample, tmp_path):
    from eventrail.llm.common import table

    placed = interleave.assign_shards(table(spark, sample, "documents"), shards=4)
    interleave.write_shards(placed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert rows_of(back, "doc_id", "text", "shard", "slot") == rows_of(placed, "doc_id", "text", "shard", "slot")
