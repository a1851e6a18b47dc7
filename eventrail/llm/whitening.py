"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of directions is multiplied by it in passes over the
centred vectors, which return one sum of the block's size; a Chebyshev polynomial of such passes
damps the directions of small variance, QR and Rayleigh-Ritz make eigenpairs of what is left,
and their residuals say when they are exact to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import ships_with_tasks, staged, table

ships_with_tasks(__name__)

COMPONENTS = 32
#: Directions that are iterated besides those wanted.
GUARD = 16
#: Residuals, as a share of the largest eigenvalue, that certify the wanted pairs, and that still do
#: when rounding lets them fall no further.
EXACT, ROUNDED = 2e-14, 1e-11
#: Components of less variance, as a share of the largest, are taken to have none.
RANK = 1e-10
#: Degrees of one polynomial, and rounds after which the block of directions is doubled.
DEGREES = (4, 24)
ROUNDS = 12
#: Entries of a stored block of vectors; sums of more blocks are added up in between.
BLOCK_ENTRIES = 1 << 19
DIRECT_SUMS = 256

SCALE, SHIFT = 64, 1_000_000
BLOCKS = "ids binary, unnamed binary, vectors binary"
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _stored(vectors: DataFrame, key: str, column: str, label: str) -> tuple[DataFrame, int]:
    """Blocks of the usable vectors as whole numbers, and their dimension."""
    entry = F.transform(F.col(column), lambda c: c.cast("double"))
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull()).where(usable)
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, BLOCK_ENTRIES // max(d, 1))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                scaled = np.floor(SCALE * np.stack(part["entries"].to_numpy()).astype(np.float64)).reshape(-1, d)
                if len(scaled) and np.abs(scaled).max() >= 1 << 52:
                    raise OverflowError("an entry is too large for whole numbers")
                yield pd.DataFrame(
                    {
                        "ids": [part["id"].to_numpy(np.int64).tobytes()],
                        "unnamed": [part["unnamed"].to_numpy(bool).tobytes()],
                        "vectors": [(scaled.astype(np.int64) + SHIFT).tobytes()],
                    }
                )

    packed = rows.where((F.size(column) == d) & (F.size(column) > 0)).select(
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("id"), F.col(key).isNull().alias("unnamed"), entry.alias("entries")
    )
    return staged(packed.mapInPandas(pack, BLOCKS), label), d


class Fit:
    """The vectors that are fitted, and sums over them."""

    def __init__(self, blocks: DataFrame, d: int) -> None:
        self.blocks, self.d = blocks, d
        self.context = blocks.sparkSession.sparkContext
        self.many = blocks.count() > DIRECT_SUMS
        counted = self._exact_sums()
        self.n, self.sums = int(counted[0]), counted[1:]

    def _exact_sums(self) -> np.ndarray:
        """The number of vectors, and the sum of each dimension."""
        d = self.d

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(d + 1, np.int64)
            for batch in batches:
                for data in batch["vectors"]:
                    x = np.frombuffer(data, np.int64).reshape(-1, d)
                    total[0] += len(x)
                    total[1:] += x.sum(0)
            yield pd.DataFrame({"place": np.arange(d + 1), "value": total})

        parts = self.blocks.mapInPandas(add, "place int, value long").groupBy("place").agg(F.sum("value").alias("value"))
        out = np.zeros(d + 1, np.int64)
        frame = parts.toPandas()  # one row per dimension
        out[frame["place"].to_numpy()] = frame["value"].to_numpy(np.int64)
        return out

    def total(self, shape: tuple[int, ...], share: Callable[[np.ndarray, tuple], np.ndarray], *given) -> np.ndarray:
        """The sum over blocks of ``share(centred vectors, given)``, an array of the shape.

        Each task adds up its own blocks. Sums of many tasks are added up in further tasks, so the
        driver gets few whatever the number of vectors.
        """
        shared = self.context.broadcast((self.n, self.sums, given))
        d = self.d

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sums, args = shared.value
            out = np.zeros(shape)
            for batch in batches:
                for data in batch["vectors"]:
                    out += share((n * np.frombuffer(data, np.int64).reshape(-1, d) - sums) / n, args)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [out.tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, part = np.zeros(shape), -1
            for batch in batches:
                for part, data in zip(batch["part"], batch["data"], strict=True):
                    out += np.frombuffer(data).reshape(shape)
            if part >= 0:
                yield pd.DataFrame({"part": [part], "data": [out.tobytes()]})

        kind = "part int, data binary"
        parts = self.blocks.mapInPandas(own, kind)
        if self.many:
            parts = parts.repartition(64, "part").sortWithinPartitions("part").mapInPandas(add, kind)
        found = sorted((r["part"], bytes(r["data"])) for r in parts.collect())
        shared.destroy()
        return sum((np.frombuffer(data).reshape(shape) for _, data in found), np.zeros(shape))

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the block: one pass over the vectors."""
        return self.total(block.shape, lambda y, given: y.T @ (y @ given[0]), block) / self.n

    def trace(self) -> float:
        return float(self.total((1,), lambda y, _: np.array([np.square(y).sum()]))[0]) / self.n


def _ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values from the largest, their directions, and the covariance times these."""
    projected = block.T @ image
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def eigenpairs(
    times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit directions, given products with the covariance.

    A round filters the block by a polynomial that is small from 0 to the block's least Ritz value, of
    the degree that the residuals ask for. Where eigenvalues lie too close for that the block is
    doubled; a block of all dimensions is exact at once.
    """
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((d, min(d, wanted + guard))))[0]
    values, block, image = _ritz(block, times(block))
    before = math.inf
    for turn in range(1, 1_000):
        residual = np.linalg.norm(image - block * values, axis=0)[:wanted].max()
        share = residual / values[0] if values[0] > 0 else 0.0
        if share <= EXACT or block.shape[1] == d or (share <= ROUNDED and share > before / 2):
            break
        before = share
        if turn % ROUNDS == 0:
            extra = rng.standard_normal((d, min(d, 2 * block.shape[1]) - block.shape[1]))
            block = np.linalg.qr(np.hstack([block, extra]))[0]
            values, block, image = _ritz(block, times(block))
            before = math.inf
            continue
        # The interval [0, cut] becomes [-1, 1]; what lies above grows with the degree.
        cut = max(values[-1], values[0] * 1e-12)
        growth = math.acosh(max(2 * values[wanted - 1] / cut - 1, 1 + 1e-9))
        degree = int(np.clip(math.ceil(math.log(share / EXACT) / growth) + 1, *DEGREES))
        centre = half = cut / 2
        first = sigma = half / (values[0] - centre) if values[0] > cut else 1.0
        older, newer = block, (image - centre * block) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            step = (times(newer) - centre * newer) * (2 * after / half) - (sigma * after) * older
            older, newer, sigma = newer, step, after
        block = np.linalg.qr(newer)[0]
        values, block, image = _ritz(block, times(block))
    else:
        raise ArithmeticError("the eigenpairs could not be certified")
    return values[:wanted], block[:, :wanted]


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    components: int = COMPONENTS,
    guard: int = GUARD,
    label: str = "whitening",
) -> DataFrame:
    """``RESULT`` for each usable vector and component, the component of most variance first.

    Vectors that are null, hold null or non-finite entries, or are of another length than most (of
    two lengths equally frequent, the longer counts), have no rows. Entries become whole numbers first,
    as the module's ``SCALE`` and ``SHIFT`` say. Components without variance are left out, so
    one vector, or equal ones, give no rows. Rows that repeat count, and come out, each.
    """
    spark = vectors.sparkSession
    blocks, d = _stored(vectors, key, column, label)
    if not d or blocks.isEmpty():
        return spark.createDataFrame([], RESULT)
    fit = Fit(blocks, d)
    trace = fit.trace()
    values, directions = eigenpairs(fit.times, d, min(components, d), guard)
    kept = (values > RANK * values[0]) & (values > 0)
    values, directions = values[kept], directions[:, kept]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    # Of the two signs, the one that makes the largest entry positive.
    largest = np.abs(directions).argmax(0)
    directions = directions * np.sign(directions[largest, np.arange(len(values))])
    whitening, k = directions / np.sqrt(values), len(values)
    mean = fit.total((k,), lambda y, given: (y @ given[0]).sum(0), whitening) / fit.n

    def spread(y: np.ndarray, given: tuple) -> np.ndarray:
        z = y @ given[0] - given[1]
        return z.T @ z

    error = float(np.abs(fit.total((k, k), spread, whitening, mean) / fit.n - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((fit.n, fit.sums, whitening, values / trace))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, turn, explained = shared.value
        for batch in batches:
            for row in batch.itertuples():
                off = n * np.frombuffer(row.vectors, np.int64).reshape(-1, d) - sums
                if np.square(off.astype(np.float64)).sum(1).max() >= 9.2e18:
                    raise OverflowError("a deviation exceeds 64 bits")
                rows, ids = len(off), np.frombuffer(row.ids, np.int64)
                yield pd.DataFrame(
                    {
                        "vec_id": pd.arrays.IntegerArray(np.repeat(ids, k), np.repeat(np.frombuffer(row.unnamed, bool), k)),
                        "component": np.tile(np.arange(1, k + 1), rows),
                        "n": n,
                        "deviation": np.repeat(np.square(off).sum(1), k),
                        "whitened": ((off / n) @ turn).ravel(),
                        "explained": np.tile(explained, rows),
                        "identity_error": error,
                    }
                )

    return blocks.mapInPandas(apply, RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 32 components of most variance."""
    return whiten(table(spark, sf_dir, "embeddings"))
