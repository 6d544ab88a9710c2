"""Filters and transforms of signals cut over many rows, against the whole arrays."""

from __future__ import annotations

import numpy as np
import pytest

from resonarium.functions import filters, recursive, resampling
from resonarium.operators import fourier
from resonarium.operators import recursive as cut

SCHEMA = "recording string, channel string, idx long, value double"


def frame(spark, signals):
    return spark.createDataFrame([("r", c, i, float(v)) for c, x in signals.items() for i, v in enumerate(x)], SCHEMA)


def arrays(df, *names):
    p = df.toPandas().sort_values("idx")
    return {c: [g[n].to_numpy() for n in names] for c, g in p.groupby("channel")}


def loop(sections, x):
    """Transfer function as one recursion, sample by sample."""
    b, a = np.ones(1), np.ones(1)
    for s in sections:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[j] * x[i - j] for j in range(min(len(b), i + 1))) - sum(a[j] * y[i - j] for j in range(1, min(len(a), i + 1)))
    return y


@pytest.mark.parametrize("order, low, high", [(2, 0.1, 0.4), (4, 0.1, 0.3), (3, 0.2, 0.7), (1, 0.3, 0.5), (3, 0.05, 0.9), (8, None, 0.3), (5, None, 0.6)])
def test_sections(order, low, high):
    x = np.random.default_rng(0).standard_normal(300)
    sections = recursive.butterworth(order, low, high)
    b, a = np.ones(1), np.ones(1)
    for s in sections:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    at = lambda f: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * f)) / np.polyval(a[::-1], np.exp(-1j * np.pi * f)))
    for edge in (low, high):
        assert edge is None or at(edge) ** 2 == pytest.approx(0.5)
    assert np.abs(np.roots(a)).max() < 1
    system, pad = recursive.System(sections), recursive.padding(order, low is not None)
    assert np.allclose(system.run(x)[0], loop(sections, x), atol=1e-10)
    there = loop(sections, np.concatenate([x, np.zeros(pad)]))
    assert np.allclose(recursive.there_and_back(x, system, pad), loop(sections, there[::-1])[::-1][: len(x)], atol=1e-10)


def test_any_chunk_size(spark):
    rng = np.random.default_rng(1)
    signals = {"a": rng.standard_normal(1003).cumsum(), "b": rng.standard_normal(640), "c": rng.standard_normal(1), "d": np.zeros(70)}
    df = frame(spark, signals)
    want = {c: filters.bandpass(x, 2, 6, 24, kind="recursive") for c, x in signals.items()}
    sections, pad = recursive.butterworth(4, 2 / 12, 6 / 12), recursive.padding(4, True)
    for chunk, group in ((64, 3), (20, 8), (100_000, 2)):
        got = arrays(cut.zero_phase(df, sections, pad, chunk, group), "value")
        assert got.keys() == want.keys()
        for c in want:
            assert np.allclose(got[c][0], want[c], atol=1e-9), (c, chunk)
    low = arrays(cut.lowpass(df, 24.0, 3.0, chunk=50), "value")
    assert all(np.allclose(low[c][0], filters.lowpass(x, 3.0, 24.0, kind="recursive"), atol=1e-9) for c, x in signals.items())
    assert all(np.array_equal(x, arrays(cut.lowpass(df, 24.0, 12.0), "value")[c][0]) for c, x in signals.items())
    with pytest.raises(ValueError):
        cut.bandpass(df, 24.0, (6.0, 2.0))


def test_shapes():
    for n in (1, 2, 3, 719, 720, 1024, 10**6, 999_983):
        s = fourier.shape(n, 1000)
        assert s["n1"] * s["n2"] == n and s["n1"] <= s["n2"] and s["w"] >= 1 and s["h"] >= 1


@pytest.mark.parametrize("row", [fourier.ROW, 64])
def test_transforms_cut_over_rows(spark, row):
    rng = np.random.default_rng(2)
    signals = {f"c{n}": rng.standard_normal(n) for n in (720, 1, 2, 719, 1024, 361)}
    df = frame(spark, signals)
    for c, (re, im) in arrays(fourier.hilbert(df, row), "re", "im").items():
        assert np.allclose(re + 1j * im, filters.analytic(signals[c]), atol=1e-10), c
    got = fourier.spectrum(df, row).withColumnRenamed("k", "idx")
    for c, (re, im) in arrays(got, "re", "im").items():
        assert np.allclose(re + 1j * im, np.fft.fft(signals[c]), atol=1e-9), c
    for c, (x,) in arrays(fourier.phase_randomized(df, 5, row), "value").items():
        assert np.allclose(np.abs(np.fft.fft(x)), np.abs(np.fft.fft(signals[c])), atol=1e-9) and (len(x) < 3 or not np.allclose(x, signals[c]))


def test_ideal_band_and_gaps(spark):
    x = np.random.default_rng(3).standard_normal(720)
    got = arrays(fourier.ideal_band(frame(spark, {"a": x}), 24.0, (2.0, 6.0), row=100), "re", "im")["a"]
    assert np.allclose(got[0], filters.bandpass(x, 2, 6, 24, kind="fft"), atol=1e-12) and np.allclose(got[1], 0, atol=1e-12)
    gone = frame(spark, {"a": x}).where("idx % 5 != 3")
    z = np.where(np.arange(720) % 5 == 3, 0, x)
    got = arrays(fourier.ideal_band(gone, 24.0, (2.0, 6.0), True, 100), "re", "im")["a"]
    assert np.allclose(got[0] + 1j * got[1], filters.band_analytic(z, 2, 6, 24, kind="fft"), atol=1e-12)


def test_ranks_and_iterated_surrogates(spark, tmp_path):
    from resonarium.session import Scratch

    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal(361), 1)  # with ties
    df = frame(spark, {"a": x, "b": -x[:50]})
    got = arrays(fourier.ranked(df, Scratch(spark, "t")), "rank")
    assert np.array_equal(got["a"][0], resampling.ranks(x)) and np.array_equal(got["b"][0], resampling.ranks(-x[:50]))
    shuffled = rng.permutation(x)

    class Given:
        def permutation(self, _):
            return shuffled

    mine = arrays(fourier.iaaft(frame(spark, {"a": x}), most=2, row=64, start=frame(spark, {"a": shuffled})), "value")["a"][0]
    assert np.allclose(mine, resampling.iaaft(x, Given(), 2), atol=1e-9)
    own = arrays(fourier.iaaft(frame(spark, {"a": x}), seed=3, most=1, row=64), "value")["a"][0]
    assert np.array_equal(np.sort(own), np.sort(x)) and not np.array_equal(own, x)


@pytest.mark.parametrize("chunk", [300, 100_000])
def test_wavelets_in_chunks(spark, chunk):
    from resonarium.functions import spectra
    from resonarium.operators import wavelet

    rng = np.random.default_rng(5)
    signals = {"a": rng.standard_normal(2000), "b": rng.standard_normal(2000), "c": rng.standard_normal(1700), "short": rng.standard_normal(20)}
    df, f = frame(spark, signals), [2.0, 4.0, 11.0]  # the last is too near half the rate and goes as a whole
    assert wavelet.split(f, 24.0, 7) == ([2.0, 4.0], [11.0]) and wavelet.split(f, 24.0, 3)[0] == []
    made = {
        "coherence": (wavelet.wavelet_coherence(df, 24.0, f, chunk=chunk), spectra.wavelet_coherence),
        "plv": (wavelet.wavelet_plv(df, 24.0, f, chunk=chunk), spectra.wavelet_plv),
        "power": (wavelet.cross_wavelet(df, 24.0, f, n_surrogates=0, chunk=chunk), spectra.cross_wavelet),
    }
    for name, (got, whole) in made.items():
        p = got.toPandas()
        for x, y in (("a", "b"), ("a", "c"), ("c", "short")):
            want = whole(signals[x], signals[y], 24.0, f)[name]
            for i, v in enumerate(f):
                one = p[(p.channel_x == x) & (p.channel_y == y) & (p.frequency == v)].sort_values("idx")
                assert list(one.idx) == list(range(min(len(signals[x]), len(signals[y]))))
                assert np.allclose(one[name], want[i], atol=1e-9), (name, x, y, v)


def test_neighbours_like_brute_force():
    from resonarium.functions import neighbours

    rng = np.random.default_rng(6)
    for d in (1, 2, 3):
        p = np.unique(np.round(rng.standard_normal((700, d)), 1), axis=0)
        w = rng.integers(1, 4, len(p))
        every = neighbours.far(p, p)
        whole = np.sort(np.repeat(every, w, axis=1), axis=1)[:, 1:6]  # one of each point's own copies is the point
        assert np.array_equal(neighbours.nearest(p, w, 5), whole[:, :5] if whole.shape[1] >= 5 else np.pad(whole, ((0, 0), (0, 5 - whole.shape[1])), constant_values=np.inf))
        reach = rng.choice([0.0, 0.1, 0.35, 1.0], len(p))
        assert np.array_equal(neighbours.within(p, w, p, reach), ((every < reach[:, None]) * w).sum(1))
        q, bound = rng.standard_normal((50, d)), rng.choice([0.2, 1.0, np.inf], 50)
        far = np.repeat(neighbours.far(q, p), w, axis=1)
        far = np.sort(np.where(far < bound[:, None], far, np.inf), axis=1)[:, :3]
        assert np.array_equal(neighbours.nearest_of(p, w, q, bound, 3), far)
    assert neighbours.nearest(np.zeros((1, 2)), np.array([1]), 2).tolist() == [[np.inf, np.inf]]


@pytest.mark.parametrize("how", [{}, {"slab": 150}, {"slab": 200, "k": 2, "l": 2, "delay": 2, "knn": 3}])
def test_transfer_entropy_in_slabs(spark, how):
    from resonarium.functions import directed
    from resonarium.operators import neighbours

    rng = np.random.default_rng(1)
    signals = {"a": rng.standard_normal(1500), "b": np.round(rng.standard_normal(1500), 1), "c": np.where(rng.random(1400) < 0.6, 0, np.round(rng.standard_normal(1400), 1)), "flat": np.ones(300)}
    signals["b"][3:] += np.round(signals["a"][:-3], 1)
    got = neighbours.te_ksg(frame(spark, signals), **how).collect()
    assert len(got) == 6
    plain = {k: v for k, v in how.items() if k != "slab"}
    for r in got:
        n = min(len(signals[r.channel_x]), len(signals[r.channel_y]))
        x, y = signals[r.channel_x][:n], signals[r.channel_y][:n]
        assert r.te_xy == pytest.approx(directed.te_ksg(x, y, **plain), abs=1e-9) and r.te_yx == pytest.approx(directed.te_ksg(y, x, **plain), abs=1e-9)


@pytest.mark.parametrize("order", [1, 3, None])
def test_networks_by_chunks(spark, order, monkeypatch):
    from resonarium.functions import directed as D
    from resonarium.operators import directed

    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 4)).cumsum(0) * 0.1 + rng.standard_normal((900, 4))
    x[2:, 1] += 0.6 * x[:-2, 0]
    df = frame(spark, {f"c{k}": np.concatenate([x[:, k], [9.0] * (k == 2)]) for k in range(4)})  # the longest channel is cut
    z = x - x.mean(0)
    p = D.best_order(z) if order is None else order
    coef, sigma = D.mvar_from_gram(*D.mvar_gram(z, p), 4, p)
    f = np.linspace(0, 12, 128)
    a, h = D.transfer(coef, f, 24.0)
    for chunk, block in ((400, 30), (2_000_000, 1 << 18)):
        monkeypatch.setattr(directed.network_grams, "__defaults__", (chunk, block))
        for got, want in ((directed.directed_transfer_function(df, 24.0, order), D.dtf(h).mean(0)), (directed.partial_directed_coherence(df, 24.0, order), D.pdc(a, sigma).mean(0))):
            rows = got.collect()
            assert {r["order"] for r in rows} == {p} and len(rows) == 16
            for r in rows:
                assert r["value"] == pytest.approx(want[int(r["target"][1]), int(r["source"][1])], abs=1e-9)


def test_whole_nonparametric_result(spark):
    from resonarium.functions import directed as D
    from resonarium.operators import directed

    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 3))
    for t in range(2, 3000):
        x[t, 1] += 0.5 * x[t - 1, 1] + 0.6 * x[t - 2, 0]
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1] * 7 + 3, "c": x[:, 2], "flat": np.ones(3000)})
    for how in ({}, {"estimator": "welch", "segment_length": 100, "n_fft": 128}, {"freq_range": (5, 20), "time_bandwidth": 3}):
        got = {(r["channel_x"], r["channel_y"]): r for r in directed.granger_spectra(df, 100.0, **how).collect()}
        assert len(got) == 6 and all(("constant" in r["status"]) == ("flat" in k) for k, r in got.items())
        for i, j in ((0, 1), (0, 2), (1, 2)):
            want, r = D.granger_nonparametric(x[:, i] * (7 if i == 1 else 1), x[:, j], 100.0, **how), got["abc"[i], "abc"[j]]
            assert np.allclose(r["spectrum_xy"], want["spectrum_xy"], atol=1e-6) and np.allclose(r["frequencies"], want["frequencies"])
            assert r["gc_xy"] == pytest.approx(want["gc_xy"], abs=1e-6) and r["gc_yx"] == pytest.approx(want["gc_yx"], abs=1e-6) and r["reconstruction_error"] < 0.02
    assert got["a", "b"]["gc_xy"] > 5 * got["a", "b"]["gc_yx"]
    short = directed.granger_spectra(frame(spark, {"a": x[:10, 0], "b": x[:10, 1]}), 100.0).collect()
    assert len(short) == 1 and "segment_length" in short[0]["status"]


def test_spectra_behind_the_peaks(spark):
    from resonarium.operators import spectral

    x = np.random.default_rng(9).standard_normal((500, 3))
    df = frame(spark, {"a": x[:, 0], "b": x[:, 0] + x[:, 1], "c": x[:, 2]})
    plain = {(r["channel_x"], r["channel_y"], r["bin"]): r for r in spectral.coherence(df, 10.0, 64).collect()}
    for r in spectral.coherence_spectra(df, 10.0, 64).collect():
        assert [s["bin"] for s in r["spectrum"]] == list(range(33)) and r["peak"] == max(s["coherence"] for s in r["spectrum"])
        assert all(s["coherence"] == pytest.approx(plain[r["channel_x"], r["channel_y"], s["bin"]]["coherence"]) for s in r["spectrum"])


def test_lagged_sums_by_chunks(spark):
    from resonarium.operators import timedom

    rng = np.random.default_rng(10)
    x = rng.standard_normal((500, 3)).cumsum(0)
    signals = {c: x[:, k] for k, c in enumerate("abc")} | {"flat": np.full(500, 0.1)}
    df = frame(spark, signals)
    for max_lag, chunk in ((7, 40), (30, 20), (0, 64), (2000, 100), (12, 65_536)):
        m = min(max_lag, 499)
        got = {(r["channel_x"], r["channel_y"]): r["v"] for r in timedom.lagged_sums(df, max_lag, chunk).collect()}
        assert len(got) == 6
        for (p, q), v in got.items():
            want = timedom.ccf(signals[p], signals[q], m, normalize=False) * 500
            assert np.allclose(v[: 2 * m + 1], want, atol=1e-6) and v[-2] == pytest.approx(((signals[p] - signals[p].mean()) ** 2).sum())
    rows = timedom.cross_correlation(df.where("channel != 'flat'"), 10.0, 5).collect()
    assert len(rows) == 33
    for r in rows:
        assert r["correlation"] == pytest.approx(timedom.ccf(signals[r["channel_x"]], signals[r["channel_y"]], 5)[r["lag"] + 5], abs=1e-9) and r["lag_sec"] == r["lag"] / 10
    unequal = frame(spark, {"a": x[:, 0], "b": x[:300, 1]})
    got = [r["correlation"] for r in timedom.cross_correlation(unequal, 10.0, 3).orderBy("lag").collect()]
    assert np.allclose(got, timedom.ccf(x[:, 0], x[:300, 1], 3))
