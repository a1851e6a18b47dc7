"""Filtering, deduplication, decontamination, redaction and encoding of a document corpus.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all
that the stage before kept. All but the last return the columns they got. Rows may hold nulls in
any column, repeat, or be none at all: a null text counts as empty, and extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm import bpe, decontaminate, neighbours, secrets, shingles
from eventrail.llm.common import staged, table


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows beside the columns that an operator needs, so that no names clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``docs``."""
    model = neighbours.fit(docs, table(spark, sf_dir, "labels"))
    scored = neighbours.score(_packed(docs, "text"), model)
    return scored.where("predicted = 1").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of near copies, by doc_id (nulls last), then text.

    Near copies share four fifths of their five-word shingles. Fingerprints do not find them all:
    at that similarity they differ in up to 17 of 64 bits, so the sets themselves are compared.
    Rows that are equal in both are one document, of which one row stays.
    """
    order = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.xxhash64("text").alias("text_hash")
    )
    groups = shingles.near_duplicates(docs.select(order.alias("key"), "text"), key="key")
    first = groups.where("key = component_id").select("key.*").distinct()
    match = docs["doc_id"].eqNullSafe(first["doc_id"]) & (F.xxhash64(docs["text"]) == first["text_hash"])
    kept = docs.join(first, match, "left_semi")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    found = decontaminate.contamination(_packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits.spans") == 0).select("__row.*")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret and ``n_chars`` to match."""
    found = secrets.scan(_packed(docs, "doc_id", "text")).select("__row", "text", "spans")
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("__row.n_chars"))
    rows = [changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return masked.select(*rows)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every document and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", redaction),
    ("byte-level BPE", encoding),
]

#: The classifier and the fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs
