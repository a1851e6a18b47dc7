"""Whitening against eigenvectors of the covariance matrix itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrail.llm import whitening
from eventrail.llm.common import table


def plain(rows, k=32):
    """{(key, component): (deviation, |whitened|, explained)} and the eigenvalues."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], np.int64)
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    deviation = [sum(int(o) ** 2 for o in row) for row in off]
    centred = off / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return deviation, e, q, centred


def check(df, rows, k=32, tolerance=1e-8):
    deviation, e, q, centred = plain(rows)
    k = min(k, int((e > whitening.RANK * e[0]).sum()))
    found = df.toPandas()
    assert len(found) == k * len(rows)
    assert set(found["n"]) == {len(rows)} and found["identity_error"].max() <= 1e-4
    assert found["identity_error"].nunique() == 1
    order = found.sort_values(["vec_id", "component"])
    got = order["whitened"].to_numpy().reshape(len(rows), k)
    at = np.argsort([key for key, _ in rows], kind="stable")
    want = (centred @ q[:, :k] / np.sqrt(e[:k]))[at]
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < tolerance
    assert order["deviation"].to_numpy().reshape(len(rows), k)[:, 0].tolist() == [deviation[i] for i in at]
    explained = order["explained"].to_numpy().reshape(len(rows), k)
    assert np.allclose(explained, e[:k] / e.sum(), rtol=1e-9, atol=0)


def made(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_sample(spark, sample):
    df = table(spark, sample, "embeddings")
    check(whitening.op11_whitening(spark, sample), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_more_dimensions_than_directions(spark):
    """Slowly falling eigenvalues of 150 dimensions, several blocks, partial sums of tasks."""
    rng = np.random.default_rng(4)
    data = rng.standard_normal((1500, 150)) * np.linspace(3, 1, 150) + rng.standard_normal(150)
    rows = [(n, v.tolist()) for n, v in enumerate(data)]
    df = made(spark, rows, "double").repartition(7)
    check(whitening.whiten(df), rows, tolerance=1e-7)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whitening, "BLOCK_ENTRIES", 150 * 40)
        patch.setattr(whitening, "DIRECT_SUMS", 4)
        check(whitening.whiten(df, components=9, guard=6), rows, 9, tolerance=1e-7)


@pytest.mark.parametrize("values", [np.ones(90), np.repeat([5.0, 2.0, 1.0], 30), np.r_[1e6, np.full(89, 1.0)],
                                    np.geomspace(1, 1e-14, 90), np.r_[np.ones(10), np.zeros(80)], np.zeros(90)])
def test_eigenpairs_of_awkward_spectra(values):
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, directions = whitening.eigenpairs(lambda b: matrix @ b, 90, 20)
    assert np.allclose(found, np.sort(values)[::-1][:20], atol=1e-12 * max(values.max(), 1))
    assert np.allclose(directions.T @ directions, np.eye(20), atol=1e-12)
    assert np.linalg.norm(matrix @ directions - directions * found, axis=0).max() <= 1e-10 * max(values.max(), 1)


def test_passes_are_few(spark):
    """Clear eigenvalues need few products, though the block has far fewer dimensions."""
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    matrix = (turn * np.geomspace(1, 1e-4, 400)) @ turn.T
    calls = []
    found, _ = whitening.eigenpairs(lambda b: calls.append(b.shape) or matrix @ b, 400, 32)
    assert np.allclose(found, np.geomspace(1, 1e-4, 400)[:32], rtol=1e-12)
    assert len(calls) < 120 and {s[1] for s in calls} == {48}


def test_awkward_vectors(spark):
    good = [(n, [float(n % 7), float(n * n % 11), 0.5]) for n in range(50)]
    good += [(50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.0])]
    bad = [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, float("nan"), 2.0]), (63, [float("inf"), 1.0, 2.0]),
           (64, []), (65, [1.0]), (66, [1.0, 2.0, 3.0, 4.0])]
    df = made(spark, good + bad).withColumn("n", F.lit("n")).withColumn("component", F.lit(None))
    check(whitening.whiten(df), good)
    named = whitening.whiten(made(spark, [(None, v) for _, v in good]))
    assert named.where("vec_id is null").count() == named.count() == 52 * 3
    for rows in ([], bad[:5], good[:1], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(made(spark, rows)).count() == 0
