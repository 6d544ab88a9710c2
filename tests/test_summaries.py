"""Accounts of results read as their results do."""

from __future__ import annotations

import numpy as np
import pytest

from resonarium.operators import fusion, phase, wavelet
from resonarium.plans import summaries


def lines(df):
    return [r["line"] for r in df.orderBy("position").collect()]


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(4)
    w = rng.random((60, 2))
    x, y = w @ rng.random((2, 4)), w @ rng.random((2, 3)) + 0.1 * rng.random((60, 3))
    return spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(60)], "obs_id long, a array<double>, b array<double>"), x, y


def test_phase_states(spark):
    df = spark.createDataFrame([("r", i, 1 + (i // 5) % 2) for i in range(20)], "recording string, idx long, state int")
    assert lines(summaries.states(df)) == ["phase states: 2 states over 20 samples", "  state 1: 50.0% of the samples", "  state 2: 50.0% of the samples"]
    (line,) = lines(summaries.transitions(phase.leida_transitions(df), phase.leida_summary(df, 10)))
    assert line.startswith("r: 19 steps between 2 states, 0.158 of them to another state")


def test_fusions(spark, blocks):
    df, x, y = blocks
    d = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    low = np.tril_indices(60, -1)
    assert lines(summaries.similarity(fusion.representational_similarity(df, ["a", "b"], compare="pearson"))) == [f"distances of a and b: {np.corrcoef(d(x)[low], d(y)[low])[0, 1]:.3f} alike"]
    a, b = (d(m) - d(m).mean(0) - d(m).mean(1)[:, None] + d(m).mean() for m in (x, y))
    dcor = np.sqrt((a * b).mean()) / np.sqrt(np.sqrt((a * a).mean()) * np.sqrt((b * b).mean()))
    for tile in (7, 256):  # as many tiles as there are, or one
        assert lines(summaries.association(fusion.distance_correlation(df, "a", "b", tile=tile), "dcor", "distance correlation")) == [f"distance correlation: {dcor:.3f} over 60 observations"]
    shares = fusion.jive(df, ["a", "b"])[1]
    told = lines(summaries.joint_and_individual(shares))
    assert len(told) == 3 and told[0].startswith("joint and individual parts of 2 blocks") and told[1].startswith("  a: joint ")
    assert lines(summaries.fused(*fusion.fuse_blocks(df, ["a", "b"]), "zscore")) == ["2 blocks fused (zscore): 60 observations of 7 features"]
    (line,) = lines(summaries.canonical(fusion.cca(df, "a", "b", ncomp=2)[1]))
    assert line.startswith("2 canonical pairs, correlations 0.") or line.startswith("2 canonical pairs, correlations 1.")
    assert lines(summaries.components(fusion.pls_blocks(df, "a", "b")[1]))[0].startswith("2 components of two blocks")
    assert lines(summaries.factors(fusion.multiple_factor_analysis(df, ["a", "b"])[1]))[0].startswith("2 common factors of all blocks, explaining ")
    assert lines(summaries.shared_factors(fusion.cross_block_factor(df, ["a", "b"], 1)[1])) == ["1 factors, 1 of them in two blocks or more"]
    assert lines(summaries.factorization(fusion.coupled_nmf(df, "a", "b", 2, n_restart=2, max_iter=30), 2))[0].startswith("coupled factors of rank 2: 0.9")
    assert lines(summaries.index(fusion.deviation_index(df, df, "a")))[0].startswith("deviation index of 60 observations from ")


def test_cross_wavelets(spark):
    t = np.arange(600) / 24
    df = spark.createDataFrame([("r", c, i, float(np.sin(2 * np.pi * 2 * t[i] + k))) for k, c in enumerate("ab") for i in range(600)], "recording string, channel string, idx long, value double")
    (line,) = lines(summaries.cross_wavelet(wavelet.cross_wavelet(df, 24.0, [1.0, 2.0], n_surrogates=0)))
    assert line == "a and b: 2 frequencies, 1200 values, most power at 2.000"
