"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents is embedded by a truncated SVD of weighted n-gram
counts. Its vectors are broadcast, the cosine of every document with every labelled vector is
computed in blocks, and the nearest labels vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrail.llm.common import ships_with_tasks, table

ships_with_tasks(__name__)

#: Bounds of the model: labelled documents, latent dimensions, neighbours that vote.
SAMPLE_ROWS = 6144
DIMENSIONS = 64
NEIGHBOURS = 25
FOLDS = 5
THRESHOLD = 0.3

_GRAMS = 2048  # hashed byte trigrams
_KINDS = 6  # lower, upper, digit, space, mark, other; their 4-grams
_LEVELS = 16  # levels of each of the word statistics
WIDTH = _GRAMS + _KINDS**4 + 2 * _LEVELS
_BLOCK = 1 << 20
_ROWS = 128


def _kinds() -> np.ndarray:
    kinds = np.full(256, 5, np.uint32)
    kinds[:128] = 4
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[[9, 10, 11, 12, 13, 32]] = 3
    return kinds


_KIND_OF = _kinds()


def features(text: str | None) -> np.ndarray:
    """Term frequencies of the whole text: byte trigrams, character kinds, word repetition."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for at in range(0, max(len(data) - 3, 0), _BLOCK):
        block = data[at : at + _BLOCK + 3]
        wide = block.astype(np.uint32)
        gram = (wide[:-2] * np.uint32(65599) + wide[1:-1]) * np.uint32(65599) + wide[2:]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(21)
        out[:_GRAMS] += np.bincount(gram[: len(block) - 3], minlength=_GRAMS)
        kind = _KIND_OF[block]
        code = ((kind[:-3] * _KINDS + kind[1:-2]) * _KINDS + kind[2:-1]) * _KINDS + kind[3:]
        out[_GRAMS : _GRAMS + _KINDS**4] += np.bincount(code, minlength=_KINDS**4)
    if len(data) > 3:
        out *= 1.0 / (len(data) - 3)
        np.sqrt(out, out)
    words = (text or "").split()
    if len(words) > 1:
        again = sum(map(eq, words, words[1:])) / (len(words) - 1)
        distinct = len(set(words)) / len(words)
        levels = WIDTH - 2 * _LEVELS
        out[levels + min(int(again * 2 * _LEVELS), _LEVELS - 1)] = 1.0
        out[levels + _LEVELS + min(int(distinct * _LEVELS), _LEVELS - 1)] = 1.0
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


@dataclass
class Model:
    projection: np.ndarray  # WIDTH x DIMENSIONS, with the inverse document frequencies in it
    vectors: np.ndarray  # one unit row per labelled document
    labels: np.ndarray
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of the nearest labels that are 1, by similarity; the prior without any."""
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts) if k else 0, _ROWS):
            raw = np.stack([features(text) for text in texts[at : at + _ROWS]])
            cosine = _unit(raw @ self.projection) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 2
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            found = total > 0
            out[at : at + len(raw)][found] = np.clip(vote[found] / total[found], 0, 1)
        return out


def _latent(weighted: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    wanted = min(dimensions, *weighted.shape)
    basis = np.random.default_rng(7).standard_normal((weighted.shape[1], min(wanted + 8, *weighted.shape)))
    basis = basis.astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    small = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
    return basis @ small[:wanted].T


def held_out(key: Column) -> Column:
    """Whether the row belongs to the fold that is never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS
) -> Model:
    """The model of at most ``rows`` labelled documents outside the held-out fold.

    The sample is the first rows in hashed key order, so that it does not depend on the order
    of files. Inverse document frequencies are those of the sample; they are part of the fit.
    Rows with a null key or label are not learned from. Without labels every score is 0.5.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = (
        known.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [features(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "quality": batch["quality"],
                    "at": [np.flatnonzero(r).astype(np.uint16).tobytes() for r in raw],
                    "value": [r[r > 0].astype(np.float16).tobytes() for r in raw],
                }
            )

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # At most ``rows`` labelled keys are broadcast and as many feature rows come back, however often
    # a key repeats.
    embedded = texts.mapInPandas(embed, "doc_id long, quality int, at binary, value binary")
    got = embedded.orderBy("doc_id", "quality", "at", "value").limit(rows).toPandas()
    raw = np.zeros((len(got), WIDTH), np.float32)
    for row, at, value in zip(raw, got["at"], got["value"], strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float16)
    if not len(got):
        nothing = np.zeros((0, 1), np.float32)
        return Model(np.zeros((WIDTH, 1), np.float32), nothing, np.zeros(0), 0.5)
    rarity = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
    raw *= rarity
    projection = _latent(_unit(raw), dimensions)
    marks = got["quality"].to_numpy(np.float64)
    return Model(rarity[:, None] * projection, _unit(raw @ projection), marks, float(marks.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; only the text is looked at.

    A null or empty text, and any text without a similar labelled one, gets the prior. All
    other columns, nulls and repeated rows pass unchanged; existing columns of these two names
    are replaced.
    """
    parts = (model.projection, model.vectors, model.labels, model.prior)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Model(*shared.value)
        for batch in texts:
            yield pd.Series(known.scores(batch.tolist()))

    scored = docs.withColumn("score", scores(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
