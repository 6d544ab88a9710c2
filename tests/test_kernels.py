"""Array kernels: identities, planted signals and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest

from resonarium.functions import directed as D
from resonarium.functions import elastic, filters, fusion, resampling, spectra

RNG = np.random.default_rng(5)


def sine(f, sr, n, phase=0.0):
    return np.sin(2 * np.pi * f * np.arange(n) / sr + phase)


def test_windows():
    assert filters.hann(1) == [1.0] and len(filters.hann(0)) == 0
    assert np.allclose(filters.hann(5), [0, 0.5, 1, 0.5, 0])
    assert np.isclose(filters.hamming(3)[0], 0.08)
    with pytest.raises(ValueError):
        filters.window("box", 4)
    with pytest.raises(ValueError):
        filters.window([1, 2], 4)


def test_parseval_and_density():
    x = RNG.standard_normal(4096)
    f, p = spectra.welch(x, 100, 256)
    assert len(f) == 129 and np.isclose(np.trapezoid(p, f), x.var(), rtol=0.1)
    f, p = spectra.welch(sine(20, 100, 1000), 100, 100)
    assert f[p.argmax()] == 20


def test_cross_spectrum_is_hermitian_and_coherence_of_itself_is_one():
    x, y = RNG.standard_normal((2, 1000))
    _, a = spectra.csd(x, y, 100, 128)
    _, b = spectra.csd(y, x, 100, 128)
    assert np.allclose(a, b.conj())
    assert np.allclose(spectra.coherence(x, x, 100, 128)["coherence"], 1)
    assert np.allclose(spectra.coherence(x, x, 100, 128, kind="imaginary")["coherence"], 0)
    assert spectra.coherence(x, y, 100, 1000)["confidence"] == 1.0


@pytest.mark.parametrize("kind", ["butter", "fir", "fft"])
def test_bandpass_keeps_and_removes(kind):
    x = sine(20, 500, 4000) + sine(100, 500, 4000)
    y = filters.bandpass(x, 15, 25, 500, kind=kind)
    mid = slice(1000, 3000)
    assert np.abs(y[mid] - sine(20, 500, 4000)[mid]).max() < 0.02
    for bad in [(-1, 5), (5, 5), (10, 300)]:
        with pytest.raises(ValueError):
            filters.bandpass(x, *bad, 500)


def test_lowpass_and_analytic():
    x = sine(5, 500, 3000) + sine(150, 500, 3000)
    assert np.abs(filters.lowpass(x, 50, 500) - sine(5, 500, 3000))[500:2500].max() < 0.01
    assert filters.lowpass(x, 250, 500) is not None and np.array_equal(filters.lowpass(x, 400, 500), x)
    z = filters.analytic(sine(5, 500, 500, 0.3))
    assert np.allclose(np.abs(z), 1, atol=1e-9) and np.allclose(z.real, sine(5, 500, 500, 0.3))


def test_resampling_grids():
    x = np.linspace(0, 1, 11)
    assert np.allclose(filters.resample_linear(x, 21), np.linspace(0, 1, 21))
    assert np.allclose(filters.natural_spline(np.arange(5.0), np.arange(5.0) * 2, np.array([0.5, 3.2])), [1, 6.4])
    assert np.allclose(filters.resample_fft(sine(3, 100, 100), 200)[::2], sine(3, 100, 100), atol=1e-9)
    assert filters.half_even(2.5) == 2 and filters.half_even(3.5) == 4
    a, b = filters.match_pair(np.zeros(100), sine(2, 200, 200), 100, 200, kind="fft")
    assert len(a) == len(b) == 100 and np.abs(b[10:90] - sine(2, 100, 100)[10:90]).max() < 0.05


@pytest.mark.parametrize("n", [256, 1500])
def test_tapers_are_orthonormal_and_concentrated(n):
    t = filters.dpss(n, 4)
    assert t.shape == (7, n) and np.allclose(t @ t.T, np.eye(7), atol=1e-6) and (t[:, 0] >= 0).all()
    p = np.abs(np.fft.rfft(t, 8 * n)) ** 2
    assert (p[:5, : 32].sum(1) / p[:5].sum(1) > 0.98).all()


def test_wavelet_coherence_is_bounded_and_high_for_shared_tone():
    x, y = sine(10, 100, 1000) + 0.1 * RNG.standard_normal(1000), sine(10, 100, 1000, -np.pi / 2) + 0.1 * RNG.standard_normal(1000)
    got = spectra.wavelet_coherence(x, y, 100, [10.0])
    assert 0 <= got["coherence"].min() and got["coherence"].max() <= 1 and got["coherence"][0, 500] > 0.95
    assert abs(got["phase"][0, 500] - np.pi / 2) < 0.1
    assert spectra.cross_wavelet(x, y, 100, [10.0])["times"][0] == 0.01
    noise = spectra.ar1_noise(20000, 0.6, 2.0, resampling.rng_of(1))
    assert abs(spectra.lag1(noise) - 0.6) < 0.03 and abs(noise.std(ddof=1) - 2) < 1e-9


def test_smoothing_matches_direct_sum():
    z, k = RNG.standard_normal(50), np.array([0.2, 0.5, 0.3])
    full = np.concatenate([z[:1], z, z[-1:]])
    assert np.allclose(spectra.smooth(z, k), [(full[i : i + 3] * k).sum() for i in range(50)])


def planted(n=4000, lag=1, c=0.6):
    x, y = np.zeros(n), np.zeros(n)
    e = RNG.standard_normal((2, n))
    for t in range(lag, n):
        x[t] = 0.5 * x[t - 1] + e[0, t]
        y[t] = 0.5 * y[t - 1] + c * x[t - lag] + e[1, t]
    return x, y


def test_granger_direction_and_agreement():
    x, y = planted()
    g = D.granger(x, y, 100, 2)
    assert g["gc_xy"] > 0.1 > 10 * g["gc_yx"]
    w = D.granger_nonparametric(x, y, 100)
    v = D.granger_nonparametric(y, x, 100)
    assert abs(w["gc_xy"] - g["gc_xy"]) / g["gc_xy"] < 0.25
    assert abs(w["gc_xy"] - v["gc_yx"]) < 1e-5
    s = D.granger_nonparametric(3 * x, y / 7, 100)
    assert abs(s["gc_xy"] - w["gc_xy"]) < 1e-5
    assert D.granger(x, y, 100, 2, (1, 20))["gc_xy"] >= 0
    with pytest.raises(ValueError):
        D.granger(x[:5], y[:5], 100, 5)
    with pytest.raises(ValueError):
        D.granger_nonparametric(np.ones(100), y[:100], 100)


def test_wilson_recovers_an_exact_factor():
    a0 = np.array([[1.0, 0.3], [0.0, 0.8]])
    a1 = np.array([[0.4, 0.1], [0.2, -0.3]])
    w = 2 * np.pi * np.arange(128) / 128
    psi = a0 + a1 * np.exp(-1j * w)[:, None, None]
    s = psi @ psi.conj().transpose(0, 2, 1)
    got = D.wilson(s, 1e-12)
    assert got["reconstruction_error"] < 1e-12
    assert np.allclose(got["Sigma"], a0 @ a0.T, atol=1e-11)
    assert np.allclose(got["H"], psi @ np.linalg.inv(a0), atol=1e-10)
    with pytest.raises(ValueError):
        D.wilson(np.full((8, 2, 2), 1j))


def test_network_measures_tell_direct_from_indirect():
    n = 4000
    e, z = RNG.standard_normal((n, 3)), np.zeros((n, 3))
    for t in range(1, n):
        z[t] = 0.4 * z[t - 1] + e[t]
        z[t, 1] += 0.8 * z[t - 1, 0]
        z[t, 2] += 0.8 * z[t - 1, 1]
    z = z - z.mean(0)
    g, m = D.mvar_gram(z, 3)
    coef, sigma = D.mvar_from_gram(g, m, 3, 3)
    f = np.linspace(0, 50, 64)
    a, h = D.transfer(coef, f, 100)
    dtf, pdc = D.dtf(h).mean(0), D.pdc(a, sigma).mean(0)
    assert dtf[2, 0] > 0.1 and pdc[2, 0] < 0.1 and pdc[1, 0] > 0.3
    assert np.allclose((D.dtf(h) ** 2).sum(2), 1) and np.allclose((D.pdc(a, sigma) ** 2).sum(1), 1)
    assert D.best_order(z) <= 5


def test_transfer_entropy_direction():
    x = RNG.standard_normal(1200)
    y = np.concatenate([np.zeros(1), 0.7 * x[:-1]]) + 0.4 * RNG.standard_normal(1200)
    for estimator in ("ksg", "histogram"):
        t = D.transfer_entropy(x, y, estimator=estimator, bins=4)
        assert t["te_xy"] > 3 * abs(t["te_yx"])
    assert np.allclose(D.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], atol=1e-12)


def test_surrogates():
    x = np.cumsum(RNG.standard_normal(501))
    for name, f in resampling.SURROGATES.items():
        s = f(x, resampling.rng_of(1, 2))
        assert len(s) == 501 and np.array_equal(s, f(x, resampling.rng_of(1, 2)))
        if name in ("aaft", "iaaft", "timeshift"):
            assert np.allclose(np.sort(s), np.sort(x))
    s = resampling.phase_randomized(x, resampling.rng_of(3))
    assert np.allclose(np.abs(np.fft.rfft(s))[1:], np.abs(np.fft.rfft(x))[1:])
    k = resampling.block_index(100, resampling.rng_of(4))
    assert len(k) == 100 and (np.diff(k)[:9] == 1).all()


def test_adjustments():
    p = np.array([0.01, 0.04, 0.03, np.nan, 0.005])
    assert np.allclose(resampling.adjust(p, "BH")[[0, 1, 2, 4]], [0.02, 0.04, 0.04, 0.02])
    assert np.allclose(resampling.adjust(p, "holm")[[0, 1, 2, 4]], [0.03, 0.06, 0.06, 0.02])
    assert np.allclose(resampling.adjust(p, "hochberg")[[0, 1, 2, 4]], [0.03, 0.04, 0.04, 0.02])
    assert np.allclose(resampling.adjust(p, "hommel")[[0, 1, 2, 4]], [0.03, 0.04, 0.04, 0.02])
    assert np.allclose(resampling.adjust(p, "bonferroni")[[0, 1, 2, 4]], [0.04, 0.16, 0.12, 0.02])
    assert np.isnan(resampling.adjust(p, "BY")[3])
    assert math.isclose(resampling.quantile8([1, 2, 3, 4], 0.5), 2.5)


def test_elastic_alignment_recovers_a_warp():
    t = np.linspace(0, 1, 61)
    x = np.exp(-((t - 0.4) ** 2) / 0.01) + 0.6 * np.exp(-((t - 0.7) ** 2) / 0.005)
    y = np.interp(t**1.4, t, x)
    got = elastic.align(x, y)
    assert np.abs(got["aligned"] - x).max() < 0.08
    q, r = elastic.srvf(x, t), elastic.srvf(y, t)
    assert got["amplitude_distance"] < np.sqrt(np.trapezoid((q - r) ** 2, t)) / 3
    assert (np.diff(got["gamma"]) >= 0).all() and got["gamma"][0] == 0 and got["gamma"][-1] == 1
    assert np.abs(elastic.from_srvf(elastic.srvf(x, t), t, x[0]) - x).max() < 0.1  # forward differences lag by half a step
    assert elastic.align(x, x)["phase_distance"] < 0.05


def centred(*blocks):
    x = np.hstack([b - b.mean(0) for b in blocks])
    return x, x.T @ x, [b.shape[1] for b in blocks]


def test_jive_matches_the_matrix_iteration():
    n = 60
    joint = RNG.standard_normal((n, 1))
    a = joint @ RNG.standard_normal((1, 8)) + RNG.standard_normal((n, 1)) @ RNG.standard_normal((1, 8)) + 0.15 * RNG.standard_normal((n, 8))
    b = joint @ RNG.standard_normal((1, 6)) + RNG.standard_normal((n, 1)) @ RNG.standard_normal((1, 6)) + 0.15 * RNG.standard_normal((n, 6))
    x, g, sizes = centred(a, b)
    got = fusion.jive(g, sizes)
    assert np.allclose(got["joint_share"] + got["individual_share"] + got["residual_share"], 1)
    blocks = [m / np.linalg.norm(m) for m in (x[:, :8], x[:, 8:])]
    own = [m * 0 for m in blocks]
    low = lambda m, r: (lambda u, s, v: (u[:, :r] * s[:r]) @ v[:r])(*np.linalg.svd(m, full_matrices=False))
    for _ in range(got["iterations"]):
        rest = np.hstack([m - o for m, o in zip(blocks, own)])
        u = np.linalg.svd(rest, full_matrices=False)[0][:, :1]
        j = low(rest, 1)
        own = [low((m - q) - u @ (u.T @ (m - q)), 1) for m, q in zip(blocks, (j[:, :8], j[:, 8:]))]
    assert np.allclose(got["joint_share"], [(j[:, :8] ** 2).sum(), (j[:, 8:] ** 2).sum()], atol=1e-8)
    assert np.allclose(x @ got["J"], j, atol=1e-6)
    assert abs(abs(np.corrcoef((x @ got["S"])[:, 0], joint[:, 0])[0, 1])) > 0.9


def test_two_block_methods_match_scores():
    n = 80
    k = RNG.standard_normal((n, 1))
    a, b = k + 0.3 * RNG.standard_normal((n, 5)), k + 0.3 * RNG.standard_normal((n, 4))
    x, g, _ = centred(a, b)
    c = fusion.cca(g / (n - 1), 5, n)
    assert c["cor"][0] > 0.9
    u, v = x[:, :5] @ c["xcoef"], x[:, 5:] @ c["ycoef"]
    assert np.allclose([np.corrcoef(u[:, i], v[:, i])[0, 1] for i in range(4)], c["cor"])
    p = fusion.pls(g, 5, n, 2)
    t, w = x[:, :5] @ p["xrotation"].T, x[:, 5:] @ p["yrotation"].T
    assert np.allclose([np.corrcoef(t[:, i], w[:, i])[0, 1] for i in range(2)], p["correlation"])
    assert abs(t[:, 0] @ t[:, 1]) < 1e-8
    m = fusion.mfa(g, [5, 4], 2)
    assert np.allclose(m["contributions"].sum(0), 1) and np.isclose((x @ m["weights"])[:, 0] @ (x @ m["weights"])[:, 0], m["eigenvalues"][0])


def test_nmf_and_factor_analysis():
    w, h1, h2 = RNG.random((80, 2)), RNG.random((2, 6)), RNG.random((2, 4))
    got = max((fusion.coupled_nmf(w @ h1, w @ h2, 2, resampling.rng_of(0, r)) for r in range(3)), key=lambda g: g["vaf"])
    assert got["vaf"] > 0.99
    with pytest.raises(ValueError):
        fusion.coupled_nmf(-w, w, 2, resampling.rng_of(0))
    load = np.zeros((8, 2))
    load[:4, 0], load[4:, 1] = 0.8, 0.7
    corr = load @ load.T
    np.fill_diagonal(corr, 1)
    found, psi = fusion.factor_analysis(corr, 2)
    assert np.allclose(np.abs(found), load, atol=1e-3) and np.allclose(psi, 1 - (load**2).sum(1), atol=1e-3)
