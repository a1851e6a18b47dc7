"""Embedding near-duplicates by sorted projection passes.

Every pass orders the vectors lexicographically by the sides of its own random planes on which
they lie, and compares each with the next few in that order; verified pairs are united across the
passes. Each plane goes through a vector of a sample, so that crowded regions are cut more often.
Passes go on in rounds until one unites nothing. Equal vectors are one class from the start. A window cannot list all links of a dense group,
so links are counted exactly inside every component, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventrail.llm.common import components, release, ships_with_tasks, staged, table, whole_groups

ships_with_tasks(__name__)

COSINE = 0.9
#: Passes of a round, and rounds in a row that must unite nothing for the search to end.
PASSES = 12
IDLE_ROUNDS = 1
BITS = 62
WINDOW = 32
SEED = 29
#: Vectors of each length that planes may go through; a sample, which decides where to look only.
SAMPLE = 512
#: Vectors of a component that are compared with one another in one task.
BLOCK = 1024


def _codes(unit: np.ndarray, passes: range, sample: np.ndarray) -> np.ndarray:
    """The sides of the planes of each pass, as one number per pass."""
    out = np.empty((len(unit), len(passes)), np.int64)
    weights = np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1]
    for n, number in enumerate(passes):
        rng = np.random.default_rng((SEED, number))
        planes = rng.standard_normal((unit.shape[1], BITS))
        through = sample[rng.integers(0, len(sample), BITS)]
        out[:, n] = (unit @ planes > np.einsum("bi,ib->b", through, planes)) @ weights
    return out


def _rows(data: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(-1, size)


class Forest:
    """Groups of numbered rows; what is united is passed on as one link per row at most."""

    def __init__(self, rows: int) -> None:
        self.parent = list(range(rows))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(self, left: np.ndarray, right: np.ndarray) -> None:
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            self.parent[max(x, y)] = min(x, y)

    def links(self, ids: np.ndarray) -> np.ndarray:
        roots = np.array([self.root(x) for x in range(len(ids))], np.int64)
        pairs = np.stack([ids, ids[roots]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)
        return pairs[pairs[:, 0] != pairs[:, 1]]


def _neighbours(frame: pd.DataFrame, window: int, cosine: float) -> np.ndarray:
    """Links among rows of one order that lie within the window and are close enough."""
    forest = Forest(len(frame))
    order = frame[["size", "pass"]].to_numpy(np.int64)
    cuts = np.flatnonzero((order[1:] != order[:-1]).any(axis=1)) + 1
    bounds = np.concatenate([[0], cuts, [len(frame)]])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        unit = _rows(frame["data"].iloc[lo:hi], int(order[lo, 0])) if hi > lo else None
        for step in range(1, min(window, hi - lo - 1) + 1):
            close = np.flatnonzero(np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= cosine)
            forest.unite(lo + close, lo + close + step)
    return forest.links(frame["vec"].to_numpy(np.int64))


def _sampled(classes: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample of the vectors of each length."""
    hashed = F.xxhash64("vec")
    order = Window.partitionBy("size", F.pmod(hashed, F.lit(16))).orderBy(hashed, "vec")
    rows = classes.select("size", "vec", "data").withColumn("n", F.row_number().over(order))
    rows = rows.where(F.col("n") <= SAMPLE // 16)
    found = rows.select("size", "data").toPandas()
    return {int(size): _rows(part["data"], int(size)) for size, part in found.groupby("size")}


def _united(classes: DataFrame, passes: int, window: int, cosine: float, label: str) -> DataFrame:
    """(node, component) of the vectors that rounds of passes unite."""
    sample = classes.sparkSession.sparkContext.broadcast(_sampled(classes))
    known, idle, done = None, 0, 0
    while idle < IDLE_ROUNDS:
        links = _pass_links(classes, range(done, done + passes), sample, window, cosine, label)
        done += passes
        if known is None:
            known = staged(components(links, label), label)
            idle = int(known.isEmpty())
            continue
        for side in ("a", "b"):
            at = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
            links = links.join(at, side, "left").withColumn(side, F.coalesce(f"{side}_in", side)).drop(f"{side}_in")
        fresh = staged(links.where("a <> b").distinct(), label)
        if fresh.isEmpty():
            idle += 1
            continue
        idle = 0
        moved = staged(components(fresh, label), label).select(
            F.col("node").alias("component"), F.col("component").alias("into")
        )
        # What a round unites may be alone so far, or stand for a component.
        alone = moved.select(F.col("component").alias("node"), "component").join(known, "node", "left_anti")
        known = staged(
            known.unionByName(alone).join(moved, "component", "left").select(
                "node", F.coalesce("into", "component").alias("component")
            ),
            label,
        )
        release(classes.sparkSession)
    return known


def _pass_links(
    classes: DataFrame, passes: range, sample: Broadcast, window: int, cosine: float, label: str
) -> DataFrame:
    """(a, b): links found by the passes, as forests."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                for at in range(0, len(rows), 2048):
                    part = rows.iloc[at : at + 2048]
                    codes = _codes(_rows(part["data"], int(size)), passes, sample.value[int(size)])
                    yield pd.DataFrame(
                        {
                            "size": size,
                            "pass": np.tile(np.array(passes), len(part)),
                            "code": codes.ravel(),
                            "vec": np.repeat(part["vec"].to_numpy(), len(passes)),
                            "data": np.repeat(part["data"].to_numpy(), len(passes)),
                        }
                    )

    order = ["size", "pass", "code", "vec"]
    columns = "size int, pass int, code long, vec long, data binary"
    dealt = (
        classes.select("size", "vec", "data")
        .mapInPandas(project, columns)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links, and the first and last rows for the comparison across partitions."""
        part = TaskContext.get().partitionId()
        names = ["a", "b", "part", "head", *order, "data"]
        tail: pd.DataFrame | None = None
        head: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if (missing := window - sum(map(len, head))) > 0:
                head.append(batch.iloc[:missing])
            frame = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            found = _neighbours(frame, window, cosine)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]}).reindex(columns=names)
            tail = frame.iloc[-window:].reset_index(drop=True)
        if tail is not None:
            yield pd.concat(head).assign(part=part, head=True).reindex(columns=names)
            yield tail.assign(part=part, head=False).reindex(columns=names)

    found = staged(dealt.mapInPandas(compare, f"a long, b long, part int, head boolean, {columns}"), label)
    edges = found.where("part is not null")
    # One row per partition that holds rows; the last rows of one meet the first of the next.
    places = edges.select("part").distinct().withColumn(
        "place", F.row_number().over(Window.orderBy("part"))
    )
    meeting = edges.join(F.broadcast(places), "part").withColumn(
        "place", F.when(F.col("head"), F.col("place") - 1).otherwise(F.col("place"))
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order).reset_index(drop=True)
        links = _neighbours(frame, window, cosine)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    across = meeting.select("place", *order, "data").groupBy("place").applyInPandas(meet, "a long, b long")
    return found.where("part is null").select("a", "b").unionAll(across)


def _counts(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(vec, n): copies of other classes of the component that are linked with the class."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    cells = (
        members.join(sizes, "component")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            (F.col("mine") <= F.col("other")).alias("first"),
            "vec",
            "copies",
            "size",
            "data",
        )
    )
    place = ["component", "low", "high"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, place):  # a group is two blocks at most
            linked = np.zeros(len(frame), np.int64)
            copies = frame["copies"].to_numpy(np.int64)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                unit = _rows(frame["data"].iloc[lo:hi], int(frame["size"].iloc[lo]))
                weight, first = copies[lo:hi], frame["first"].to_numpy(bool)[lo:hi]
                if frame["low"].iloc[lo] == frame["high"].iloc[lo]:
                    close = unit @ unit.T >= cosine
                    np.fill_diagonal(close, False)
                    linked[lo:hi] = close @ weight
                else:
                    close = unit[first] @ unit[~first].T >= cosine
                    linked[lo:hi][first] = close @ weight[~first]
                    linked[lo:hi][~first] = close.T @ weight[first]
            yield pd.DataFrame({"vec": frame["vec"].to_numpy(), "n": linked})

    dealt = cells.repartition(*place).sortWithinPartitions(*place, "vec")
    return dealt.mapInPandas(count, "vec long, n long").groupBy("vec").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
    block: int = BLOCK,
    label: str = "projections",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors(vec_id, embedding)``.

    Cosines are in double precision. A vector that is null, empty or zero, or that holds null
    or non-finite components, links with nothing and is a component of its own; so is a row
    without an id, whose component is null and which is not kept. Vectors of different length
    never link. Rows that repeat count as other vectors. Pairs are found with the probability
    that the passes give, which go on until a round of them unites nothing; within a component
    all links are counted.
    """
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    rows = whole.withColumn("usable", usable)

    @F.pandas_udf("binary")
    def unit(arrays: pd.Series) -> pd.Series:
        out = []
        for array in arrays:
            values = np.asarray(array, np.float64)
            values = values / np.abs(values).max()  # so that squares neither vanish nor overflow
            out.append((values / np.sqrt(values @ values)).tobytes())
        return pd.Series(out)

    distinct = (
        rows.where("usable")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
    )
    classes = staged(
        distinct.select(
            "embedding", "vec", "copies", F.size("embedding").alias("size"), unit("embedding").alias("data")
        ),
        label,
    )
    groups = _united(classes, passes, window, cosine, label)
    members = classes.join(groups, F.col("vec") == F.col("node")).select(
        "component", "vec", "copies", "size", "data"
    )
    counts = _counts(members, cosine, block)
    known = (
        classes.select("embedding", "vec", "copies")
        .join(groups.withColumnRenamed("node", "vec"), "vec", "left")
        .join(counts, "vec", "left")
        .select(
            "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec").alias("component_id"),
        )
    )
    found = rows.where("usable").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.unionAll(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def op10_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
part AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN part ON part.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
