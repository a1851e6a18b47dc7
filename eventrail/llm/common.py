"""What the training-data operators share: tables, staging, row numbers, components."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventrail.session import configure, scratch_path


def ships_with_tasks(module: str) -> None:
    """Send the module's functions inside the tasks: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ships_with_tasks(__name__)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that end where a group ends, with the bounds of the groups in them.

    For rows that are dealt and sorted by integer ``keys``. What is held between batches is one
    group, so the callers bound the size of a group.
    """
    held: pd.DataFrame | None = None

    def bounds(frame: pd.DataFrame) -> np.ndarray:
        key = frame[keys].to_numpy(np.int64)
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        return np.concatenate([[0], new, [len(key)]])

    for batch in batches:
        if len(batch):
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cuts = bounds(frame)
            if cuts[-2]:
                yield frame.iloc[: cuts[-2]], cuts[:-1]
            held = frame.iloc[cuts[-2] :].reset_index(drop=True)
    if held is not None:
        yield held, bounds(held)


#: Bytes in one batch of rows for Python: texts differ in length by orders of magnitude.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again.

    Cuts the lineage: nothing above depends on an executor's local files, and values that
    depend on how rows were dealt (row numbers, partition ids) are fixed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing later reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished jobs that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[str], out: str, label: str) -> DataFrame:
    """Gapless row numbers from 0 in the given order, without a single-task sort.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by
    the row counts of the partitions before. Only one count per partition meets in one task.
    The order should end in a column that tells rows apart, or a value that fills more than a
    partition cannot be split.
    """
    local = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(
        dealt.withColumn("__part", F.spark_partition_id()).withColumn(
            "__local", local.bitwiseAND(F.lit((1 << 33) - 1))
        ),
        label,
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("__part")
        .agg(F.count("*").alias("__rows"))
        .withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .select("__part", "__start")
    )
    # One row per partition: as small as the list of tasks that the driver holds anyway.
    joined = rows.join(F.broadcast(starts), "__part")
    return joined.withColumn(out, F.col("__start") + F.col("__local")).drop(
        "__part", "__local", "__start"
    )


def _priority(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("id"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component: its smallest node.

    Rounds of contraction: each node hooks to the neighbour that comes first in a hashed
    order, edges are rewritten to the parents, and edges inside a parent vanish. A hashed
    order shrinks chains by a constant factor a round whatever the ids. Each round is
    staged in the shared folder; minima are combined before they are shuffled, so the hub of
    a large group is no hot key.
    """
    links = staged(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        label,
    )
    rounds = []
    while not links.isEmpty():
        sides = links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a")))
        parents = staged(
            sides.groupBy(F.col("a").alias("node"))
            .agg(F.min(_priority(F.col("b"))).alias("near"))
            .select("node", F.least(_priority(F.col("node")), F.col("near"))["id"].alias("parent")),
            label,
        )
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = links.join(left, "a").join(right, "b").where("pa <> pb")
        links = staged(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            label,
        )
    kind = edges.schema["a"].dataType
    if not rounds:
        empty = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
        return edges.sparkSession.createDataFrame([], empty)
    found = rounds[0].select("node", F.col("parent").alias("at"))
    for parents in rounds[1:]:
        step = parents.select(F.col("node").alias("at"), F.col("parent").alias("next"))
        found = found.join(step, "at", "left").select("node", F.coalesce("next", "at").alias("at"))
    found = staged(found, label)
    smallest = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(smallest, "at").select("node", "component")
