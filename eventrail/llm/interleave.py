"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed inside their source and ranked; the fraction of the source that
comes before a row orders all rows, so that every stretch of that order holds the sources in
their overall proportions; the order is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import numbered, table

SHARDS = 40
SEED = 17


def assign_shards(
    rows: DataFrame,
    key: str = "doc_id",
    stratum: str = "source",
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``rows`` with its ``shard`` (0 to shards-1) and gapless ``slot`` in it.

    Both ranks come from range-partitioned sorts, so a source with a third of all rows is many
    tasks. Pass only the columns that are needed to place rows and join texts by key later.
    A null source is a source of its own; null keys and repeated rows are placed like any
    others (rows that are equal in every column are interchangeable); an empty table gives an
    empty result. Columns named like the helper columns ``__*`` must not exist.
    """
    rest = [c for c in rows.columns if c not in (key, stratum)]
    placed = rows.withColumn(
        "__stratum", F.concat(F.col(stratum).isNotNull().cast("string"), F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    ).withColumn("__shuffle", F.xxhash64(F.lit(seed), F.col(key), *[F.col(c) for c in rest]))
    ties = ["__stratum", "__shuffle", key, *rest]
    ranked = numbered(placed, ties, "__at", "interleave")
    strata = ranked.groupBy("__stratum").agg(
        F.count("*").alias("__rows"), F.min("__at").alias("__first")
    )
    total = max(1, ranked.count())
    part = (F.lit(2) * (F.col("__at") - F.col("__first")) + 1) / (F.lit(2) * F.col("__rows"))
    spread = ranked.join(strata, "__stratum").withColumn("__part_of", part).drop("__at", "__first", "__rows")
    ordered = numbered(spread, ["__part_of", *ties], "__at", "interleave")
    shard = F.expr(f"__at * {shards} div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # ceil(shard * total / shards)
    return (
        ordered.withColumn("shard", shard)
        .withColumn("slot", F.col("__at") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .drop("__stratum", "__shuffle", "__part_of", "__at")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Rows as one folder per shard, each in slot order; one task writes a stretch of a shard."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def op2_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by the law of equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = assign_shards(docs)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
