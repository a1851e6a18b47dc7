"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are leaves; leaves are encoded on their own, and neighbours
are joined by encoding a window around their boundary again. A match of the splitting pattern
never runs from a character that is no white space into a space or line feed, so such a place is
a match boundary whatever stands around it: once the window has one on either side, no token
outside it can change. Decoding concatenates decoded parts up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import ships_with_tasks, table

ships_with_tasks(__name__)

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF = 4096  # characters of a leaf, or ids when decoding
_WINDOW = 32  # characters that a boundary window first reaches to either side


@dataclass
class Part:
    """An element of the monoid: a stretch of text and its ids."""

    text: str
    ids: list[int]


def _stable(text: str, at: int) -> bool:
    """Whether a match boundary lies before ``at`` whatever stands around the text."""
    return text[at] in " \n" and not text[at - 1].isspace()


def _last_stable(text: str) -> int:
    """The last stable place, looking back ever further; 0 if there is none."""
    reach, seen = _WINDOW, len(text)
    while seen > 1:
        low = max(1, len(text) - reach)
        for at in range(seen - 1, low - 1, -1):
            if _stable(text, at):
                return at
        seen, reach = low, 2 * reach
    return 0


def _first_stable(text: str) -> int:
    """The first stable place, looking ever further; the whole text if there is none."""
    for at in range(1, len(text)):
        if _stable(text, at):
            return at
    return len(text)


class Coder:
    """Encodes and decodes by the ranks of a vocabulary file, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF) -> None:
        pairs = map(bytes.split, ranks.splitlines())
        self.encoding = tiktoken.Encoding(
            "ranks",
            pat_str=pattern,
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
            special_tokens={},
        )
        self.leaf = leaf
        self.plain = self.encoding.encode_ordinary

    def join(self, left: Part, right: Part) -> Part:
        if not left.text or not right.text:
            return right if not left.text else left
        low, high = _last_stable(left.text), _first_stable(right.text)
        tail, head = left.text[low:], right.text[:high]
        kept = len(left.ids) - (len(self.plain(tail)) if low else len(left.ids))
        dropped = len(self.plain(head)) if high < len(right.text) else len(right.ids)
        ids = left.ids[:kept] + self.plain(tail + head) + right.ids[dropped:]
        return Part(left.text + right.text, ids)

    def part(self, text: str) -> Part:
        if len(text) <= self.leaf:
            return Part(text, self.plain(text))
        half = len(text) // 2
        return self.join(self.part(text[:half]), self.part(text[half:]))

    def encode(self, text: str | None) -> list[int]:
        return self.part(text or "").ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def ranks_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        return file.read()


def _shared(spark: SparkSession, ranks: bytes | None, leaf: int):
    # A vocabulary file is a megabyte whatever the corpus.
    return spark.sparkContext.broadcast((ranks or ranks_file(), public_tokenizers.PATTERN, leaf))


def encoded(text: Column, spark: SparkSession, ranks: bytes | None = None, leaf: int = LEAF) -> Column:
    """Ids of each whole text; none for null and empty texts."""
    shared = _shared(spark, ranks, leaf)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(*shared.value)
        for batch in texts:
            yield pd.Series([coder.encode(t) for t in batch])

    return ids(text)


def decoded(ids: Column, spark: SparkSession, ranks: bytes | None = None, leaf: int = LEAF) -> Column:
    """The bytes that ids stand for; null ids give no bytes."""
    shared = _shared(spark, ranks, leaf)

    @F.pandas_udf("binary")
    def data(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(*shared.value)
        for batch in rows:
            yield pd.Series([coder.decode([] if r is None else [int(i) for i in r]) for r in batch])

    return data(ids)


def round_trip(docs: DataFrame, ranks: bytes | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    Null and empty texts have no tokens. Texts are encoded and decoded again in one pass, and
    ids never leave the task. Other columns and repeated rows pass unchanged.
    """
    shared = _shared(docs.sparkSession, ranks, leaf)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(*shared.value)
        spelled = [str(i) for i in range(coder.encoding.n_vocab)].__getitem__
        for batch in texts:
            rows = []
            for text in batch:
                ids = coder.encode(text)
                listed = ",".join(map(spelled, ids)).encode()
                back = hashlib.sha256(coder.decode(ids)).hexdigest()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), back))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("__digest", digests(F.col("text"))).select(
        *[c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")],
        "__digest.*",
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
