"""Keyed permutations are bijections, and statistics under them are those of the arrays so permuted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonarium.operators import permutations as P
from resonarium.session import Scratch


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_bijections(n):
    i = np.arange(n)
    seen = [P.moved(i, n, 7, rep) for rep in range(20)]
    assert all(np.array_equal(np.sort(m), i) for m in seen)
    assert n < 64 or (len({m.tobytes() for m in seen}) == 20 and max(abs(np.corrcoef(i, m)[0, 1]) for m in seen) < 0.6)
    assert np.array_equal(P.moved(i[n // 2 :], n, 7, 3), seen[3][n // 2 :])  # a row's place needs no other row


def test_places_are_even():
    n, counts = 50, np.zeros((50, 50))
    for rep in range(4000):
        counts[np.arange(n), P.moved(np.arange(n), n, 1, rep)] += 1
    assert ((counts - 80) ** 2 / 80).sum() / n**2 == pytest.approx(1, abs=0.1)


def blocks(spark, n, related):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 3))
    y = x[:, :2] * related + rng.standard_normal((n, 2))
    return x, y, spark.createDataFrame([(int(5 * k - 40), x[k].tolist(), y[k].tolist()) for k in range(n)], "obs_id long, x array<double>, y array<double>").repartition(5)


def test_numbers_follow_the_ids(spark):
    _, _, df = blocks(spark, 500, 1)
    got = P.numbered(df, "obs_id", Scratch(spark, "t")).orderBy("obs_id").select("i").collect()
    assert [r["i"] for r in got] == list(range(500))


def test_coefficients_of_permuted_rows(spark, monkeypatch):
    x, y, df = blocks(spark, 300, 0.3)
    monkeypatch.setattr(P, "BLOCK", 64)
    monkeypatch.setattr(P, "BATCH", 4)
    got = {r["rep"]: r["rv"] for r in P.permuted_rv(df, "x", "y", permutations=10, seed=5).collect()}
    a, b = x - x.mean(0), y - y.mean(0)
    scale = np.sqrt(((a.T @ a) ** 2).sum() * ((b.T @ b) ** 2).sum())
    for rep in range(-1, 10):
        to = np.arange(300) if rep < 0 else P.moved(np.arange(300), 300, 5, rep)
        shuffled = np.empty_like(b)
        shuffled[to] = b
        assert got[rep] == pytest.approx(((a.T @ shuffled) ** 2).sum() / scale)
    with pytest.raises(ValueError):
        P.permuted_rv(df, "x", "y", permutations=0)


def test_p_values(spark):
    for related, least, most in ((0.5, 0.0, 0.03), (0.0, 0.03, 1.0)):
        r = P.rv_test(blocks(spark, 200, related)[2], "x", "y", permutations=99, seed=1).first()
        assert r["permutations"] == 99 and least <= r["p_value"] <= most
    flat = blocks(spark, 50, 1)[2].withColumn("y", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r["rv"] for r in P.permuted_rv(flat, "x", "y", permutations=2).collect()} == {None}


def test_blocks_are_never_broadcast(spark):
    """Adaptive plans take small blocks for a broadcast by the size that they have after compression."""
    df = blocks(spark, 3000, 0.5)[2]
    rows = P.permuted_rv(df, "x", "y", permutations=3)
    assert len(rows.collect()) == 4
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_rv_association_holds_no_table_in_a_task(spark, monkeypatch):
    """The draws are those of the array form: b[rng.permutation(n)]."""
    from resonarium.functions.resampling import rng_of
    from resonarium.operators import fusion

    monkeypatch.setattr(P, "BLOCK", 64)
    x, y, df = blocks(spark, 300, 0.05)
    a, b = x - x.mean(0), y - y.mean(0)
    stats = [((a.T @ z) ** 2).sum() for z in [b, *(b[rng_of(2, rep).permutation(300)] for rep in range(39))]]
    got = fusion.association_p(df, "x", "y", "rv", permutations=39, seed=2)
    assert "named_struct(id," not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.first()
    assert r["p_value"] == (1 + sum(s >= stats[0] for s in stats[1:])) / 40
    assert r["statistic"] == pytest.approx(stats[0] / np.sqrt(((a.T @ a) ** 2).sum() * ((b.T @ b) ** 2).sum()))
    places = P.drawn(2)(300, 5)
    assert np.array_equal(b[rng_of(2, 5).permutation(300)][places], b)
