"""Equi-joins of large record tables with lookup tables of unknown size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
#: How many times its files' size a table may take in memory.
COMPRESSION = 20
SALTS = 32
#: Records of one key above which they are spread over salts.
HOT_ROWS = 100_000


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as text, one aggregate over the table."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the table is provably small: by its statistics, else by measuring it.

    The statistics of a scan are the size of compressed files, so they count as proof only
    far below the limit.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate * COMPRESSION <= limit or measured_bytes(df) <= limit


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[Column] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join records with a lookup table on equal keys.

    A lookup of checked size is broadcast, so the records do not move. A larger one is
    joined by shuffling, with the records of a hot key spread over salts (``spread`` names
    columns that tell records of one key apart) and the lookup rows of such a key repeated per
    salt. Keys are counted before; those that are hot are few. Records without a key match nothing
    and are spread as well.
    """
    if fits_broadcast(lookup, limit):
        return facts.join(F.broadcast(lookup), on, how)
    if spread is None:
        return facts.join(lookup, on, how)
    salted, repeated = _spread_hot(facts, lookup, on, spread)
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def _spread_hot(
    facts: DataFrame, lookup: DataFrame, on: list[str], spread: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt, which is 0 for all but the records of hot keys and of none."""
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    # Keys of so many records are few. Those that share their values are spread as well, which is harmless.
    found = counts.where(F.col("__rows") > HOT_ROWS).select(*on).dropna().collect()
    values = [sorted({row[name] for row in found}) for name in on]
    hot = reduce(lambda a, b: a & b, [F.col(name).isin(some) for name, some in zip(on, values, strict=True)])
    no_key = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in on])
    salt = F.when(hot | no_key, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return facts.withColumn("__salt", salt.cast("int")), lookup.withColumn("__salt", F.explode(salts))
