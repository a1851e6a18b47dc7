"""Recall of the projection passes where a third of all vectors is crowded."""

import numpy as np
import pytest

from eventrail.llm import projections


def crowded(rng, rows, cosine, pairs, dims=64):
    """Vectors of which a third lie at about ``cosine`` to one another, and planted pairs at 0.9 and a bit."""
    data = rng.standard_normal((rows, dims))
    data /= np.linalg.norm(data, axis=1)[:, None]
    centre = rng.standard_normal(dims)
    centre /= np.linalg.norm(centre)
    data[: rows // 3] = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * data[: rows // 3]
    twins = rng.choice(rows // 3, pairs // 2, replace=False).tolist() + (rows // 3 + np.arange(pairs // 2)).tolist()
    noise = rng.standard_normal((len(twins), dims))
    for n, at in enumerate(twins):
        base = data[at] / np.linalg.norm(data[at])
        side = noise[n] - (noise[n] @ base) * base
        data = np.vstack([data, 0.905 * base + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side)])
    return data / np.linalg.norm(data, axis=1)[:, None]


@pytest.mark.parametrize("cosine", [0.6, 0.75])
def test_recall_of_links_and_groups(spark, cosine):
    rng = np.random.default_rng(11)
    data = crowded(rng, 6000, cosine, 300)
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in projections.near_duplicates(frame.repartition(6)).collect()}
    close = data @ data.T >= 0.9
    np.fill_diagonal(close, False)
    want = close.sum(1)
    got = np.array([found[n]["n_links"] for n in range(len(data))])
    assert (got <= want).all()
    asked = np.arange(0, len(data), 20)  # the query set, and all
    assert got[asked].sum() >= 0.9 * want[asked].sum()
    assert got.sum() >= 0.95 * want.sum() > 500
    parts = {n: found[n]["component_id"] for n in found}
    same = [parts[int(x)] == parts[int(y)] for x, y in zip(*np.nonzero(np.triu(close)), strict=True)]
    assert np.mean(same) >= 0.95
