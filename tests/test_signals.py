"""Signal operators: container behaviour, planted signals, and equality of array and Spark paths."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonarium.functions import directed as D
from resonarium.functions import spectra
from resonarium.model import SignalSet
from resonarium.operators import align, directed, fusion, inference, lodo, pac, phase, plots, spectral, timedom
from resonarium.plans import registry
from resonarium.sources import signals
from resonarium.streaming import sliding


def tall(spark, recording="r", **channels):
    return spark.createDataFrame([(recording, c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)], "recording string, channel string, idx long, value double")


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(600)
    y = 0.6 * np.roll(x, 5) + 0.4 * rng.standard_normal(600)
    return x, y, tall(spark, x=x, y=y).cache()


def test_container(spark):
    s = SignalSet.of(signals.eeg_emg(spark, 1, 2, 1), {"EEG": 500.0, "EMG": 1000.0})
    assert len(s) == 2 and "EEG (2 channels at 500 Hz)" in repr(s)
    assert [(r["modality"], r["sr"], r["offset"]) for r in s.alignment.orderBy("modality").collect()] == [("EEG", 500.0, 0.0), ("EMG", 1000.0, 0.0)]
    assert len(s.modality(1)) == len(s.modality("EMG")) == 1
    cut = s.slice(["EMG"], 0.1, 0.2)
    assert cut.samples.agg(F.min("idx"), F.max("idx")).first() == (0, 100)
    for bad in (lambda: s.slice(None, 2, 1), lambda: s.slice(["nope"]), lambda: s.modality(9)):
        with pytest.raises((ValueError, KeyError)):
            bad()
    with pytest.raises(ValueError):
        SignalSet(s.samples.drop("value"), s.channels)
    assert s.with_result("k", 1).with_modality("EEG", s.modality("EEG").samples, s.modality("EEG").channels).results == {}


def test_slice_reaches_the_scan(spark, tmp_path):
    signals.coupled_signals(spark, 100, 100, duration=2).write.parquet(f"file://{tmp_path}/s")
    s = SignalSet.of(spark.read.parquet(f"file://{tmp_path}/s"), {"x": 100.0, "y": 100.0}).slice(["x"], 0.5, 1.0)
    plan = s.samples._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(idx,50)" in pushed and "LessThan" in pushed


def test_alignment_and_merge(spark):
    s = SignalSet.of(signals.eeg_emg(spark, 1, 1, 1), {"EEG": 500.0, "EMG": 1000.0})
    for method, n in (("lowest_rate", 500), ("common_rate", 1000)):
        assert {r[1] for r in align.align(s, method, kind="fft").samples.groupBy("modality").agg(F.count("*")).collect()} == {n}
    with pytest.raises(ValueError):
        align.align(s, "resample")
    a = align.align(s, kind="fft")
    both = align.merge_sets(a.modality("EEG"), a.modality("EMG"))
    assert sorted(r["channel"] for r in both.channels.collect()) == ["x_EEG1", "y_EMG1"]
    with pytest.raises(ValueError):
        align.merge_sets(s.modality("EEG"), s.modality("EMG"))
    assert align.align(SignalSet.of(signals.eeg_emg(spark, 0.1, 1, 1), {"EEG": 500.0, "EMG": 1000.0}), "elastic", kind="fft").samples.count() == 100


def test_spectra_match_arrays(spark, pair):
    x, y, df = pair
    want = spectra.coherence(x, y, 100, 128)
    got = spectral.coherence(df, 100, 128).orderBy("bin").collect()
    assert np.allclose([r["coherence"] for r in got], want["coherence"]) and np.isclose(got[0]["confidence"], want["confidence"])
    f, p = spectra.welch(x, 100, 128)
    assert np.allclose([r["psd"] for r in spectral.welch_psd(df.where("channel = 'x'"), 100, 128).orderBy("bin").collect()], p)
    for kind in ("imaginary", "lagged"):
        assert np.allclose([r["coherence"] for r in spectral.coherence(df, 100, 128, kind=kind).orderBy("bin").collect()], spectra.coherence(x, y, 100, 128, kind=kind)["coherence"])
    psi = spectral.phase_slope_index(df, 100, (5, 30), 128).first()["psi"]
    swapped = tall(spark, x=y, y=x)
    assert psi > 0 and np.isclose(spectral.phase_slope_index(swapped, 100, (5, 30), 128).first()["psi"], -psi, atol=1e-9)
    with pytest.raises(ValueError):
        spectral.coherence(df, 100, method="multitaper")


def test_cross_correlation_sign(pair):
    _, _, df = pair
    r = timedom.correlation_peak(timedom.cross_correlation(df, 500)).first()
    assert (r["peak_lag"], r["peak_lag_sec"]) == (-5, -0.01)
    frame = plots.coupling_timecourse_frame(timedom.sliding_cross_correlation(df, 100, 1, 0.5))
    assert frame.count() == 11


def test_phase_measures_of_a_fixed_lag(spark):
    t = np.arange(1000) / 100
    df = tall(spark, x=np.sin(2 * np.pi * 8 * t), y=np.sin(2 * np.pi * 8 * t - np.pi / 2))
    r = phase.synchrony(df, 100, (6, 10), kind="fft").first()
    assert r["plv"] > 0.999 and r["pli"] == 1 and r["wpli"] > 0.999 and r["ciplv"] > 0.99 and r["ppc"] > 0.99
    df = tall(spark, x=np.sin(2 * np.pi * 8 * t), y=np.sin(2 * np.pi * 8 * t))
    assert phase.synchrony(df, 100, (6, 10), kind="fft").first()["aec"] < 0.1


def test_leida_vectors_match_eigenvectors(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.standard_normal((4, 300)), 1)
    rows = phase.leida_vectors(tall(spark, **{f"c{k}": v for k, v in enumerate(x)}), 100, (5, 15), kind="fft").orderBy("idx", "channel").collect()
    v = np.array([r["v"] for r in rows]).reshape(300, 4)
    from resonarium.functions import filters

    p = np.angle(filters.band_analytic(x, 5, 15, 100, kind="fft"))
    for i in range(0, 300, 37):
        e = np.linalg.eigh(np.cos(p[:, i][:, None] - p[:, i][None, :]))[1][:, -1]
        assert np.isclose(abs(e @ v[i]), 1, atol=1e-9) and (v[i] > 0).sum() >= (v[i] < 0).sum()


def test_state_metrics(spark):
    df = spark.createDataFrame([("r", i, 1 + i % 2) for i in range(100)], "recording string, idx long, state int")
    assert {(r["state_from"], r["state_to"], r["p"]) for r in phase.leida_transitions(df).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    r = phase.leida_summary(df, 10).first()
    assert (r["switching_rate"], r["switching_hz"], r["entropy"]) == (1.0, 10.0, 0.0)
    runs = spark.createDataFrame([("r", i, 1 + (i // 20) % 2) for i in range(200)], "recording string, idx long, state int")
    assert {r["mean_dwell"] for r in phase.leida_dwell(runs, 10).collect()} == {2.0}


@pytest.fixture(scope="module")
def theta_gamma():
    rng = np.random.default_rng(8)
    t = np.arange(3000) / 500
    wander = np.interp(t, np.linspace(0, 6, 25), rng.uniform(-1, 1, 25))
    ph = 2 * np.pi * np.cumsum(6 + wander) / 500
    return np.sin(ph) + (0.1 + (1 + np.cos(ph - np.pi)) / 2) * np.sin(2 * np.pi * 50 * t) + 0.3 * rng.standard_normal(3000)


def test_phase_amplitude_coupling(spark, theta_gamma):
    df, flat = tall(spark, x=theta_gamma), tall(spark, x=np.random.default_rng(1).standard_normal(3000))
    on = pac.phase_amplitude_coupling(df, df, 500, (4, 8), (40, 60)).first()["pac"]
    off = pac.phase_amplitude_coupling(flat, flat, 500, (4, 8), (40, 60)).first()["pac"]
    assert on > 0.01 and off < 0.005 and on > 5 * off
    best = pac.peak(pac.comodulogram(df, df, 500, [6, 10, 14], [50, 80, 110], 2, 20)).first()
    assert (best["phase_freq"], best["amp_freq"]) == (6, 50)
    grid = pac.modulation_index(df, df, 500, [6, 12], [50, 90], 2, 20, n_surrogates=20)
    found = {(r["phase_freq"], r["amp_freq"]): r for r in grid.collect()}
    assert found[(6, 50)]["p_value"] == 1 / 21 and found[(6, 50)]["pac"] > found[(6, 50)]["threshold"]
    for bad in (dict(n_surrogates=5), dict(method="plv"), dict(surrogate="none")):
        with pytest.raises(ValueError):
            pac.modulation_index(df, df, 500, [6], [50], **bad)
    with pytest.raises(ValueError):
        pac.check_frequencies([3, 2], "f")
    framed = plots.comodulogram_frame(grid, grid)
    assert framed.count() == 4 and set(framed.columns) == {"phase_freq", "amp_freq", "pac", "opacity"}


def test_metrics_of_a_closed_form(spark):
    ph = np.linspace(-np.pi, np.pi, 512, endpoint=False)
    amp = 1 + 0.5 * np.cos(ph)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(ph, amp)], "k int, phase double, amp double")
    assert np.isclose(pac.strength(df, ["k"], "canolty").first()["pac"], 0.25)
    assert np.isclose(pac.strength(df, ["k"], "ozkurt").first()["pac"], 0.25 / np.sqrt((amp**2).mean()))
    assert np.isclose(sum(r["share"] for r in pac.distribution(df, ["k"]).collect()), 1)
    zero = df.withColumn("amp", F.lit(0.0))
    assert pac.strength(zero, ["k"], "tort").first()["pac"] == pac.strength(zero, ["k"], "ozkurt").first()["pac"] == 0


def test_directed_matches_arrays(spark, pair):
    x, y, df = pair
    want = D.granger(x, y, 100, 5)
    got = directed.granger_causality(df, 100, 5).first()
    assert np.isclose(got["gc_xy"], want["gc_xy"]) and np.isclose(got["gc_yx"], want["gc_yx"]) and got["status"] == "ok"
    band = D.granger(x, y, 100, 5, (5, 20))
    assert np.isclose(directed.granger_causality(df, 100, 5, (5, 20)).first()["gc_xy"], band["gc_xy"])
    short = tall(spark, x=x[:4], y=y[:4])
    assert directed.granger_causality(short, 100, 5).count() == 0 or directed.granger_causality(short, 100, 5).first()["status"] != "ok"
    flat = tall(spark, x=np.ones(100), y=x[:100])
    assert "constant" in directed.granger_causality(flat, 100, method="nonparametric").first()["status"]
    te = directed.te_histogram(df).first()
    assert np.isclose(te["te_xy"], D.te_histogram(x, y)) and np.isclose(te["te_yx"], D.te_histogram(y, x))


def test_registry_scalars_agree_with_array_statistics(spark, pair):
    x, y, df = pair
    args = {"plv": dict(band=(5, 15)), "pli": dict(band=(5, 15)), "wpli": dict(band=(5, 15)), "pac": dict(phase_band=(2, 6), amp_band=(20, 40)), "wavelet_coherence": dict(frequencies=[5.0]), "wavelet_plv": dict(frequencies=[5.0]), "transferentropy": dict(estimator="histogram")}
    for name in registry.METHODS:
        a = args.get(name, {})
        value = registry.coupling_matrix(df, 100, name, **a).first()["value"]
        assert np.isclose(value, registry.statistic(name, 100, **a)(x, y), atol=1e-9), name
    with pytest.raises(ValueError):
        registry.coupling_analysis(df, 100, "nope")


def test_cache_follows_the_data(spark, pair):
    _, _, df = pair
    s = SignalSet.of(df, {"r": 100.0})
    _, s, hit = registry.coupling_analysis_cached(s, "r", 100, "crosscorrelation", max_lag=3)
    _, s, again = registry.coupling_analysis_cached(s, "r", 100, "crosscorrelation", max_lag=3)
    moved = SignalSet(s.samples.withColumn("value", F.col("value") + 1), s.channels, None, s.results)
    assert (hit, again, registry.coupling_analysis_cached(moved, "r", 100, "crosscorrelation", max_lag=3)[2]) == (False, True, False)


def test_inference_does_not_depend_on_partitions(spark, pair):
    _, _, df = pair
    stat = registry.statistic("coherence", 100, nperseg=128)
    a = inference.surrogate_matrix_test(df, stat, 19, "phase").first()
    b = inference.surrogate_matrix_test(df.repartition(5), stat, 19, "phase").first()
    assert (a["p_value"], a["threshold_95"]) == (b["p_value"], b["threshold_95"]) and a["p_value"] == 1 / 20
    ci = inference.bootstrap_ci(df, stat, 19).first()
    assert ci["lower"] <= ci["upper"]
    with pytest.raises(ValueError):
        inference.surrogate_test(df, stat, 5, "none")


def test_surrogate_matrix_query_finds_a_coupled_pair(spark, tmp_path):
    from resonarium import queries

    rng, start = np.random.default_rng(3), datetime.datetime(2024, 1, 1)
    common, rows = rng.standard_normal(720), []
    for k in range(720):
        for name, v in (("a", common[k]), ("b", common[k] + 0.2 * rng.standard_normal()), ("c", rng.standard_normal())):
            rows.append((start + datetime.timedelta(hours=k), name, float(v)))
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {(r["channel_x"], r["channel_y"]): r for r in queries.QUERIES["surrogate_matrix"](spark, f"file://{tmp_path}").collect()}
    assert got["a", "b"]["significant"] and got["a", "b"]["p_value"] == 1 / 200


def test_adjustments_match_arrays(spark):
    from resonarium.functions.resampling import adjust

    p = [0.01, 0.04, 0.03, None, 0.005, 0.2, 0.04]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    for m in ("BH", "BY", "holm", "hochberg", "hommel", "bonferroni", "none"):
        got = [r["p_adjusted"] for r in inference.adjusted(df, "p", [], m).orderBy("i").collect()]
        want = adjust([np.nan if v is None else v for v in p], m)
        assert all((g is None or np.isnan(g)) if np.isnan(w) else np.isclose(g, w) for g, w in zip(got, want)), m


def test_by_adjustment_of_large_and_of_empty_groups(spark):
    """The harmonic sum is made once for a group, not for each row; a group of nulls only has none."""
    from resonarium.functions.resampling import adjust

    p = [(k * 7919 % 40009 + 1) / 40010 for k in range(40000)]
    df = spark.createDataFrame([("large", i, v) for i, v in enumerate(p)] + [("empty", i, None) for i in range(3)], "g string, i int, p double")
    rows = inference.adjusted(df, "p", ["g"], "BY")
    assert rows.columns == ["g", "i", "p", "p_adjusted"] and "sequence(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["g"], r["i"]): r["p_adjusted"] for r in rows.collect()}
    assert np.allclose([got["large", i] for i in range(40000)], adjust(p, "BY")) and [got["empty", i] for i in range(3)] == [None] * 3


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(6)
    z = rng.standard_normal((60, 1))
    a, b = z + 0.4 * rng.standard_normal((60, 4)), z + 0.4 * rng.standard_normal((60, 3))
    return a, b, spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(60)], "obs_id long, a array<double>, b array<double>").cache()


def test_fusion_matches_matrices(spark, blocks):
    a, b, df = blocks
    x, y = a - a.mean(0), b - b.mean(0)
    rv = ((x.T @ y) ** 2).sum() / np.sqrt(((x.T @ x) ** 2).sum() * ((y.T @ y) ** 2).sum())
    assert np.isclose(fusion.rv_coefficient(df, "a", "b").first()["rv"], rv)
    dist = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    centre = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    u, v = centre(dist(a)), centre(dist(b))
    dcor = np.sqrt((u * v).mean()) / np.sqrt(np.sqrt((u * u).mean()) * np.sqrt((v * v).mean()))
    assert np.isclose(fusion.distance_correlation(df, "a", "b").first()["dcor"], dcor)
    low = np.tril_indices(60, -1)
    assert np.isclose(fusion.representational_similarity(df, ["a", "b"], compare="pearson").first()["similarity"], np.corrcoef(dist(a)[low], dist(b)[low])[0, 1])
    ties = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 9, 9, 9, 4)], "v double")
    assert {r["v"]: r["rank"] for r in fusion.average_ranks(ties, "v").collect()} == {1.0: 1.0, 2.0: 2.5, 4.0: 4.0, 9.0: 6.0}
    order = lambda v: np.argsort(np.argsort(v))
    assert np.isclose(fusion.representational_similarity(df, ["a", "b"]).first()["similarity"], np.corrcoef(order(dist(a)[low]), order(dist(b)[low]))[0, 1])
    cor = lambda m: 1 - np.corrcoef(m)
    assert np.isclose(fusion.representational_similarity(df, ["a", "b"], method="correlation", compare="pearson").first()["similarity"], np.corrcoef(cor(a)[low], cor(b)[low])[0, 1])
    assert fusion.association_p(df, "a", "b", "rv", permutations=19).first()["p_value"] == 1 / 20
    assert fusion.cca(df, "a", "b")[1].orderBy("pair").first()["cor"] > 0.9
    with pytest.raises(ValueError):
        fusion.block_sizes(df.union(spark.createDataFrame([(99, [1.0], [1.0])], df.schema)), ["a", "b"])
    with pytest.raises(ValueError):
        fusion.block_sizes(df, ["a"])


def test_fusion_outputs(blocks):
    a, b, df = blocks
    scores, shares = fusion.jive(df, ["a", "b"])
    assert scores.count() == 60 and all(np.isclose(r["joint"] + r["individual"] + r["residual"], 1) for r in shares.collect())
    fused, places = fusion.fuse_blocks(df, ["a", "b"])
    m = np.array([r["fused"] for r in fused.orderBy("obs_id").collect()])
    assert np.allclose(m, (np.hstack([a, b]) - np.hstack([a, b]).mean(0)) / np.hstack([a, b]).std(0, ddof=1))
    assert [(r["start"], r["end"]) for r in places.orderBy("start").collect()] == [(1, 4), (5, 7)]
    index = {r["id"]: r["index"] for r in fusion.deviation_index(df, df, "a").collect()}
    assert abs(np.mean(list(index.values())) - 100) < 1e-6
    _, shared, fs = fusion.cross_block_factor(df, ["a", "b"], 1)
    assert shared.first()["shared"] and fs.count() == 60
    pos = df.select("obs_id", F.transform("a", lambda v: F.abs(v)).alias("a"), F.transform("b", lambda v: F.abs(v)).alias("b"))
    assert fusion.coupled_nmf(pos, "a", "b", 2, n_restart=2, max_iter=50).first()["vaf"] > 0.5
    rows, hx, hy = fusion.coupled_nmf_rows(pos, "a", "b", 2, max_iter=5)
    assert rows.count() == 60 and hx.shape == (2, 4) and hy.shape == (2, 3)


def test_cross_site_folds_match_direct_fits(spark):
    rng = np.random.default_rng(7)
    site = np.repeat(["a", "b", "c"], 40)
    f = rng.standard_normal((120, 2))
    y = 2 + f @ [1.0, -0.5] + 0.3 * rng.standard_normal(120)
    rows = [(s, *map(float, v), float(w), "yes" if w > 2 else "no") for s, v, w in zip(site, f, y)] + [("a", None, 1.0, 2.0, "yes"), (None, 1.0, 1.0, 1.0, "no")]
    df = spark.createDataFrame(rows, "site string, f1 double, f2 double, y double, improved string")
    got = {r["site"]: r for r in lodo.lodo(df, "y", "site", ["f1", "f2"]).collect()}
    for s in "abc":
        m = site != s
        design = lambda k: np.column_stack([np.ones(k.sum()), f[k]])
        beta = np.linalg.lstsq(design(m), y[m], rcond=None)[0]
        err = y[~m] - design(~m) @ beta
        assert np.isclose(got[s]["rmse"], np.sqrt((err**2).mean())) and (got[s]["n_train"], got[s]["n_test"]) == (80, 40)
    out = lodo.lodo(df, "improved", "site", ["f1", "f2"], "binomial", "yes")
    assert all(r["auc"] > 0.9 for r in out.collect()) and lodo.overall(out).first()["n_sites"] == 3
    skipped = lodo.lodo(df, "y", "site", ["f1"], min_train_rows=1000).collect()
    assert {r["status"] for r in skipped} == {"skipped"} and {r["rmse"] for r in skipped} == {None}
    with pytest.raises(ValueError):
        lodo.lodo(df.where("site = 'a'"), "y", "site", ["f1"])


def test_streamed_spans_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{m:02d}:00", c, float((h * 7 + m * (1 + len(c))) % 13)) for h in range(96) for m in (5, 35) for c in ("x", "yy")]
    df = spark.createDataFrame(rows, "t string, channel string, value double").select(F.to_timestamp("t").alias("ts"), "channel", "value")
    df.repartition(1).write.parquet(f"file://{tmp_path}/e")
    batch, _ = sliding.sliding_correlation(df, "x", "yy")
    want = {r["start"]: (r["n"], round(r["correlation"], 9)) for r in batch.collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/e")
    out, mode = sliding.sliding_correlation(stream, "x", "yy")
    q = out.writeStream.outputMode(mode).format("memory").queryName("spans").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["start"]: (r["n"], round(r["correlation"], 9)) for r in spark.sql("select * from spans").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def _flat_and_busy(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [("r", c, i, float(v)) for c in "ab" for i, v in enumerate(rng.standard_normal(n))] + [("r", "flat", i, 0.0) for i in range(n)] + [("r", "high", i, 7.0) for i in range(n)]
    return spark.createDataFrame(rows, "recording string, channel string, idx long, value double")


ARGS = {"coherence": {"nperseg": 64}, "plv": {"band": (8, 12)}, "pli": {"band": (8, 12)}, "wpli": {"band": (8, 12)}, "crosscorrelation": {"max_lag": 10}, "pac": {"phase_band": (4, 8), "amp_band": (20, 40)}, "transferentropy": {"estimator": "histogram"}, "multitaper_coherence": {}, "granger": {}, "dtf": {}, "pdc": {}}


@pytest.mark.parametrize("name", sorted(ARGS))
def test_a_flat_channel_spares_the_other_pairs(spark, name):
    got = {(r["channel_x"], r["channel_y"]): r["value"] for r in registry.coupling_matrix(_flat_and_busy(spark), 100.0, name, **ARGS[name]).collect()}
    if name in ("dtf", "pdc"):  # one model of the whole recording, which a dead channel makes singular
        return
    assert got[("a", "b")] is not None and np.isfinite(got[("a", "b")])
    if name == "plv":
        assert got[("a", "flat")] < 0.5


def test_flat_channels_in_the_synchrony_table(spark):
    rows = {(r["channel_x"], r["channel_y"]): r for r in phase.synchrony(_flat_and_busy(spark), 100.0, (8, 12), kind="fft").collect()}
    alone = rows[("a", "flat")]
    assert alone["plv"] < 0.5 and alone["ppc"] < 0.5 and alone["aec"] == 0 and alone["wpli"] is None
    psi = {(r["channel_x"], r["channel_y"]): r["psi"] for r in spectral.phase_slope_index(_flat_and_busy(spark), 100.0, (8, 20), 64).collect()}
    assert psi[("a", "flat")] is None and np.isfinite(psi[("a", "b")])


def test_a_short_signal_is_one_segment(spark):
    x = np.random.default_rng(1).standard_normal(100)
    df = spark.createDataFrame([("r", c, i, float(v * (1 + k))) for k, c in enumerate("ab") for i, v in enumerate(x)], "recording string, channel string, idx long, value double")
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(100) / 99))
    want = np.abs(np.fft.rfft(x * w)) ** 2 / (50 * (w**2).sum())
    want[1:-1] *= 2
    got = [r["psd"] for r in spectral.welch_psd(df, 50.0).where("channel = 'a'").orderBy("bin").collect()]
    assert np.allclose(got, want)
    both = spectral.coherence(df, 50.0).collect()
    assert len(both) == 51 and all(abs(r["coherence"] - 1) < 1e-9 and r["confidence"] == 1.0 for r in both)


def _two_rates(spark):
    rng = np.random.default_rng(2)
    slow = rng.standard_normal(600).cumsum() * 0.1 + rng.standard_normal(600)
    fast = np.interp(np.arange(1200) / 2, np.arange(600), slow)
    rows = [("s", "p", i, float(v)) for i, v in enumerate(slow)] + [("s", "q", i, float(v)) for i, v in enumerate(rng.standard_normal(600))]
    rows += [("f", "u", i, float(v)) for i, v in enumerate(fast + 0.1 * rng.standard_normal(1200))] + [("f", "v", i, float(v)) for i, v in enumerate(rng.standard_normal(1200))]
    df = spark.createDataFrame(rows, "recording string, channel string, idx long, value double")
    return SignalSet.of(df, {"s": 100.0, "f": 200.0}), slow, fast


@pytest.mark.parametrize("name", sorted({*registry.METHODS}))
def test_two_recordings_of_two_rates(spark, name):
    s, _, _ = _two_rates(spark)
    got = {(r["channel_x"], r["channel_y"]): r["value"] for r in registry.coupling_matrix_between(s, "s", "f", name, channels_x=["p"], **ARGS.get(name, {})).collect()}
    assert set(got) == {("p", "u"), ("p", "v")} and all(v is not None for v in got.values())
    if name in ("coherence", "crosscorrelation", "plv"):
        assert got[("p", "u")] > got[("p", "v")]
    if name == "pac":
        got = registry.coupling_matrix_between(s, "s", "f", name, method="plv", **ARGS["pac"]).collect()
        assert len(got) == 4 and all(0 <= r["value"] <= 1 for r in got)


def test_pairs_of_recordings_are_checked(spark):
    from resonarium.operators import pairs

    s, slow, _ = _two_rates(spark)
    with pytest.raises(ValueError):
        pairs.matched(s, "s", "none")
    with pytest.raises(ValueError):
        pairs.matched(s, "s", "f", ["zzz"])
    with pytest.raises(ValueError):
        s.slice(["s"], 100.0, 200.0)
    rows, sr = pairs.matched(s, "s", "f")
    counts = {r["channel"]: r["count"] for r in rows.groupBy("channel").count().collect()}
    assert sr == 100.0 and set(counts) == {"x:p", "x:q", "y:u", "y:v"} and len(set(counts.values())) == 1
    x = [r["value"] for r in rows.where("channel = 'x:p'").orderBy("idx").collect()]
    assert np.allclose(x, slow[: len(x)])


def test_merged_labels_get_their_prefix_once(spark):
    df = spark.createDataFrame([("m", "x", 0, 1.0), ("m", "x", 1, 2.0)], "recording string, channel string, idx long, value double")
    a = SignalSet.of(df, {"m": 10.0})
    a = SignalSet(a.samples, a.channels.withColumn("label", F.lit(None).cast("string")))
    assert sorted(r["label"] for r in align.merge_sets(a, a).channels.collect()) == ["x_x", "y_x"]
