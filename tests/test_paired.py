"""Spearman similarity without kept pairs: every pair once, exact ranks from slices, nothing of the pairs on disk."""

from __future__ import annotations

import time

import numpy as np
import pytest

from resonarium.functions import paired
from resonarium.operators import fusion


def ranks(v):
    _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def drawn(kind, n=260):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 5 if kind in ("correlation", "flat") else 2))
    y = x[:, :4] + rng.standard_normal((n, x.shape[1]))[:, :4]
    ids = 7 * np.arange(n) - 900
    if kind == "twice":
        ids //= 20
    if kind == "copies":
        x[: n // 2], y[: n // 3] = x[0], y[0]
        x[n // 2 :] = np.round(x[n // 2 :], 1)
    if kind == "near":
        x[: n // 2] = x[0] + 1e-9 * rng.standard_normal((n // 2, 2))
        y[: n // 2] = y[0] + x[: n // 2] - x[0] + 1e-10 * rng.standard_normal((n // 2, 2))
    if kind == "far":
        x, y = x + 1e5, 1e-150 * y
    if kind == "undefined":
        x[5, 0], y[7, 1], y[9, 1] = np.nan, np.inf, np.inf
    if kind == "flat":
        x[:20] = 1.0
    return x, y, ids, "correlation" if x.shape[1] == 5 else "euclidean"


def distances(x, y, ids, metric):
    u, v = np.tril_indices(len(ids), -1)
    u, v = (z[ids[u] != ids[v]] for z in (u, v))
    with np.errstate(all="ignore"):
        d = [np.sqrt(((z[u] - z[v]) ** 2).sum(1)) if metric == "euclidean" else paired.finished(paired.raw(z[u].T, z[v].T, metric), metric) for z in (x, y)]
    return [np.where(np.isnan(z), np.inf, z) for z in d]


def summed(x, y, ids, metric, most):
    bounds = paired.bounds_of(x, y, ids, metric)
    counts = [sum(c) for c in zip(*(paired.counted(x, y, ids, metric, bounds, k, 3) for k in range(3)))]
    one = sum(np.array(paired.products(x, y, ids, metric, bounds, counts, *r)) for r in paired.ranges(counts[0], most))
    two = sum(np.array(paired.products(y, x, ids, metric, bounds[::-1], counts[::-1], *r)) for r in paired.ranges(counts[1], most))
    assert np.isclose(one[2], two[2], rtol=1e-9, atol=1e-9 * one[0])
    return bounds, counts, one, two


KINDS = ["plain", "twice", "copies", "near", "far", "undefined", "correlation", "flat"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_single_distances_as_slices_leave_nothing_out(kind):
    x, y, ids, metric = drawn(kind)
    x, y = paired.ready(x, metric), paired.ready(y, metric)
    a, b = (ranks(d) for d in distances(x, y, ids, metric))
    for most in (1 << 20, 3000):
        _, counts, one, two = summed(x, y, ids, metric, most)
        assert counts[0].sum() == len(a) and paired.left_out(counts) == 0
        assert np.isclose((one[1] + two[1] - one[2]) / np.sqrt(one[0] * two[0]), np.corrcoef(a, b)[0, 1], rtol=1e-11)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_few_slices_keep_exact_ranks(kind, monkeypatch):
    """Leaves, pieces and chunks far smaller than the table; some distances lie outside all that the bounds were taken from."""
    for name, value in {"LEAF": 8, "WIDE": 16, "AT_ONCE": 1000, "SEEN": 5000, "BOUNDS": 90, "CHUNK": 64}.items():
        monkeypatch.setattr(paired, name, value)
    x, y, ids, metric = drawn(kind)
    x, y = paired.ready(x, metric), paired.ready(y, metric)
    two_d = distances(x, y, ids, metric)
    a, b = (ranks(d) - (len(d) + 1) / 2 for d in two_d)
    bounds, counts, one, two = summed(x, y, ids, metric, 2000)
    slices = [2 * np.searchsorted(s, d) + np.isin(d, s) for s, d in zip(bounds, two_d)]
    for k in range(2):
        assert (np.bincount(slices[k], minlength=len(counts[k])) == counts[k]).all()
        assert (paired.finder(bounds[k])(two_d[k]) == slices[k]).all()
    m, w = (paired.middles(c)[s] for c, s in zip(counts, slices))
    size = np.sqrt((a @ a) * (b @ b))
    for got, real in zip((*one, *two), (a @ a, a @ w, m @ w, b @ b, b @ m, m @ w)):
        assert np.isclose(got, real, rtol=1e-9, atol=1e-9 * size)
    assert abs((one[1] + two[1] - one[2]) - a @ b) / size <= paired.left_out(counts) + 1e-9


@pytest.mark.parametrize("kind", ["plain", "twice", "correlation"])
def test_similarity(spark, kind, monkeypatch):
    monkeypatch.setattr(fusion, "SLICE_PAIRS", 3000)
    x, y, ids, metric = drawn(kind)
    df = spark.createDataFrame([(int(i), u.tolist(), v.tolist()) for i, u, v in zip(ids, x, y)], "obs_id long, a array<double>, b array<double>").repartition(5)
    want = np.corrcoef(*(ranks(d) for d in distances(paired.ready(x, metric), paired.ready(y, metric), ids, metric)))[0, 1]
    for most in (fusion.MOST_BROADCAST, 0):
        monkeypatch.setattr(fusion, "MOST_BROADCAST", most)
        assert np.isclose(fusion.representational_similarity(df, ["a", "b"], method=metric).first()["similarity"], want, rtol=1e-9)
    assert fusion.representational_similarity(df.limit(1), ["a", "b"], method=metric).first()["similarity"] is None
    assert fusion.representational_similarity(df.limit(0), ["a", "b"], method=metric).first()["similarity"] is None


def test_pairs_do_not_travel(spark, monkeypatch):
    """499,500 pairs in several tasks; before, each went through two shuffles with 16 bytes."""
    monkeypatch.setattr(fusion, "LEAST_PART", 250)
    monkeypatch.setattr(fusion, "SLICE_PAIRS", 100_000)
    x = np.random.default_rng(0).standard_normal((1000, 4))
    df = spark.createDataFrame([(k, r[:2].tolist(), r[2:].tolist()) for k, r in enumerate(x)], "obs_id long, a array<double>, b array<double>")

    def written():
        time.sleep(1)  # until the session's figures are in
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert fusion.representational_similarity(df, ["a", "b"]).first()["similarity"] is not None
    assert written() - before < 4 * 499_500
