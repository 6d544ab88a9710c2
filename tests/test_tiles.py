"""Distance matrices in tiles: every pair met once, sums as of the whole matrices, whatever the tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from resonarium.operators import fusion

N = 150


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(fusion, "SIDE", 16)
    monkeypatch.setattr(fusion, "LEAST_PART", 40)


def table(spark, x, y):
    return spark.createDataFrame([(7 * k - 300, x[k].tolist(), y[k].tolist()) for k in range(len(x))], "obs_id long, a array<double>, b array<double>").repartition(4)


def dist(m):
    return np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))


def drawn():
    """Far from the origin, with copies and with near copies."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((N, 4))
    y = x[:, :3] + 0.5 * rng.standard_normal((N, 3))
    x[100:120], y[100:115] = x[3], y[4]
    x[120:130] = x[5] + 1e-9 * rng.standard_normal((10, 4))
    return x + 1e5, y - 3e4


def test_every_pair_is_met_once(spark):
    x, y = drawn()

    def kernel(number, ids_l, ids_r, same, pieces):
        met = [(u, v) for at, to, _ in pieces for u in ids_l[at].tolist() for v in ids_r[to].tolist() if not same or u > v]
        return pa.table({"u": pa.array([min(p) for p in met], pa.int64()), "v": pa.array([max(p) for p in met], pa.int64())})

    tiles = fusion._tiles(table(spark, x, y), ["a"], "obs_id", kernel, "u long, v long")
    got = [tuple(r) for r in tiles.collect()]
    assert len(got) == len(set(got)) == N * (N - 1) // 2


def test_sums_of_tiles(spark):
    x, y = drawn()
    df, low = table(spark, x, y), np.tril_indices(N, -1)
    a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (dist(x), dist(y)))
    dcov = np.sqrt((a * b).mean())
    r = fusion.distance_correlation(df, "a", "b").first()
    assert r["n"] == N and np.isclose(r["dcov"], dcov, rtol=1e-9) and np.isclose(r["dcor"], dcov / np.sqrt(np.sqrt((a * a).mean()) * np.sqrt((b * b).mean())), rtol=1e-9)
    assert np.isclose(fusion.representational_similarity(df, ["a", "b"], compare="pearson").first()["similarity"], np.corrcoef(dist(x)[low], dist(y)[low])[0, 1], rtol=1e-9)


def test_flat_blocks_have_no_distances(spark):
    x, _ = drawn()
    df = table(spark, x, np.full((N, 2), 0.1))
    assert tuple(fusion.distance_correlation(df, "a", "b").first()) == (0.0, 0.0, N)
    assert fusion.representational_similarity(df, ["a", "b"], compare="pearson").first()["similarity"] is None


def test_ranks_of_distances_by_slices(spark, monkeypatch):
    monkeypatch.setattr(fusion, "SLICE_PAIRS", 500)  # some 22 slices; before, no slices and a row for each pair
    x, y = drawn()
    x = np.round(x, 1)  # many equal distances
    low = np.tril_indices(N, -1)

    def ranks(v):
        _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[inverse]

    got = fusion.representational_similarity(table(spark, x, y), ["a", "b"]).first()["similarity"]
    assert np.isclose(got, np.corrcoef(ranks(dist(x)[low]), ranks(dist(y)[low]))[0, 1], rtol=1e-9)
    assert fusion.representational_similarity(table(spark, np.zeros((9, 2)), y[:9]), ["a", "b"]).first()["similarity"] is None
