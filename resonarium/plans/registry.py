"""One entry for every coupling method: how to run it on all pairs, and the scalar that sums it up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.functions import directed as D
from resonarium.functions import filters, spectra
from resonarium.model import SignalSet
from resonarium.operators import directed, pac, pairs, phase, spectral, timedom, wavelet
from resonarium.operators.packed import pack

PAIR = ["recording", "channel_x", "channel_y"]


@dataclass(frozen=True)
class Method:
    """run(samples, sr, **args) gives the full result; scalar(result) gives (pair, value); stat(x, y, sr, **args) is the scalar of two arrays, for replicates."""

    run: Callable[..., DataFrame]
    scalar: Callable[[DataFrame], DataFrame]
    stat: Callable[..., float]


def _agg(value) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*PAIR).agg(value().alias("value"))


def _column(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*PAIR, F.col(name).alias("value"))


def _network(df: DataFrame) -> DataFrame:
    """From source x to target y, for each unordered pair."""
    return df.where("source < target").select("recording", F.col("source").alias("channel_x"), F.col("target").alias("channel_y"), "value")


def _unit(x, y, sr, band, order=4, kind="butter"):
    zx, zy = (filters.band_analytic(v, band[0], band[1], sr, order, kind) for v in (x, y))
    return zx * zy.conj()


def _plv(x, y, sr, **a) -> float:
    c = _unit(x, y, sr, **a)
    return float(abs(np.exp(1j * np.angle(c)).mean()))


def _pli(x, y, sr, **a) -> float:
    return float(abs(np.sign(_unit(x, y, sr, **a).imag).mean()))


def _wpli(x, y, sr, debiased=True, **a) -> float:
    im = _unit(x, y, sr, **a).imag
    s, m, q = im.sum(), np.abs(im).sum(), (im**2).sum()
    den = m * m - q if debiased else m
    return float("nan") if den <= 0 else float((s * s - q) / den if debiased else abs(s) / den)


def _pac_run(samples: DataFrame, sr: float, **a) -> DataFrame:
    """The phase of x and the envelope of y for each pair, both banks made once a channel."""
    order, kind = a.get("order", 4), a.get("kind", "butter")
    method, n_bins = a.get("method", "tort"), a.get("n_bins", 18)
    p, b = a.get("phase_band", (4, 8)), a.get("amp_band", (30, 80))
    packed = pack(samples)
    ph = pac.bank(packed, [(sum(p) / 2, *map(float, p))], sr, "phase", order, kind).select("recording", F.col("channel").alias("channel_x"), "idx", F.col("v").alias("phase"))
    am = pac.bank(packed, [(sum(b) / 2, *map(float, b))], sr, "envelope" if method != "plv" else "slow", order, kind, slow=p).select("recording", F.col("channel").alias("channel_y"), "idx", F.col("v").alias("amp"))
    return pac.strength(ph.join(am, ["recording", "idx"]).where("channel_x < channel_y"), PAIR, method, n_bins)


def _pac_stat(x, y, sr, phase_band=(4, 8), amp_band=(30, 80), method="tort", n_bins=18, order=4, kind="butter") -> float:
    p, b = [(0.0, *map(float, phase_band))], [(0.0, *map(float, amp_band))]
    if method == "plv":
        phi = np.angle(filters.band_analytic(x, *p[0][1:], sr, order, kind))
        return float(abs(np.exp(1j * (phi - pac.slow_phase(y, *b[0][1:], phase_band, sr, order, kind))).mean()))
    return float(pac.grid_arrays(x, y, p, b, sr, method, n_bins, order, kind)[0, 0])


def _net_stat(measure):
    def stat(x, y, sr, order=5, band=None) -> float:
        z = np.stack([x, y], 1)
        f = np.linspace(0, sr / 2, 128)
        g, n = D.mvar_gram(z - z.mean(0), order)
        a, s = D.mvar_from_gram(g, n, 2, order)
        keep = np.ones(128, bool) if band is None else (f >= band[0]) & (f <= band[1])
        return float(measure(a, s, f, sr)[keep].mean(0)[1, 0])

    return stat


def _peak(x, y, sr, max_lag=None, **_) -> float:
    n = min(len(x), len(y))
    return float(np.abs(timedom.ccf(x, y, n // 4 if max_lag is None else max_lag)).max())


METHODS: dict[str, Method] = {
    "coherence": Method(lambda s, sr, **a: spectral.coherence(s, sr, **a), _agg(lambda: F.max(F.abs("coherence"))), lambda x, y, sr, **a: float(np.abs(spectra.coherence(x, y, sr, **a)["coherence"]).max())),
    "multitaper_coherence": Method(lambda s, sr, **a: spectral.multitaper_coherence(s, sr, **a), _agg(lambda: F.max(F.abs("coherence"))), lambda x, y, sr, **a: float(spectra.multitaper_coherence(x, y, sr, **a)["coherence"].max())),
    "plv": Method(lambda s, sr, **a: phase.phase_locking_value(s, sr, **a), _column("plv"), _plv),
    "pli": Method(lambda s, sr, **a: phase.phase_lag_index(s, sr, **a), _column("pli"), _pli),
    "wpli": Method(lambda s, sr, **a: phase.weighted_pli(s, sr, **a), _column("wpli"), _wpli),
    "granger": Method(lambda s, sr, **a: directed.granger_causality(s, sr, **a), _column("gc_xy"), lambda x, y, sr, **a: D.granger(x, y, sr, **a)["gc_xy"]),
    "crosscorrelation": Method(lambda s, sr, **a: timedom.cross_correlation(s, sr, **a), _agg(lambda: F.max(F.abs("correlation"))), _peak),
    "wavelet_coherence": Method(lambda s, sr, **a: wavelet.wavelet_coherence(s, sr, **a), _agg(lambda: F.avg("coherence")), lambda x, y, sr, **a: float(spectra.wavelet_coherence(x, y, sr, **a)["coherence"].mean())),
    "wavelet_plv": Method(lambda s, sr, **a: wavelet.wavelet_plv(s, sr, **a), _agg(lambda: F.avg("plv")), lambda x, y, sr, **a: float(spectra.wavelet_plv(x, y, sr, **a)["plv"].mean())),
    "dtf": Method(lambda s, sr, **a: directed.directed_transfer_function(s, sr, **a), _network, _net_stat(lambda a, s, f, sr: D.dtf(D.transfer(a, f, sr)[1]))),
    "pdc": Method(lambda s, sr, **a: directed.partial_directed_coherence(s, sr, **a), _network, _net_stat(lambda a, s, f, sr: D.pdc(D.transfer(a, f, sr)[0], s))),
    "transferentropy": Method(lambda s, sr, **a: directed.transfer_entropy(s, **a), _column("te_xy"), lambda x, y, sr, **a: D.transfer_entropy(x, y, **a)["te_xy"]),
    "pac": Method(_pac_run, _column("pac"), _pac_stat),
}


def method(name: str) -> Method:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; one of {sorted(METHODS)}")
    return METHODS[name]


def coupling_analysis(samples: DataFrame, sr: float, name: str = "coherence", **args) -> DataFrame:
    """The full result of a method for all pairs of channels."""
    return method(name).run(samples, sr, **args)


def coupling_matrix(samples: DataFrame, sr: float, name: str = "coherence", **args) -> DataFrame:
    """Rows (recording, channel_x, channel_y, value)."""
    m = method(name)
    return m.scalar(m.run(samples, sr, **args))


def coupling_between(s: SignalSet, modality_x: str, modality_y: str, name: str = "coherence", channels_x: list[str] | None = None, channels_y: list[str] | None = None, match: str = "butter", **args) -> DataFrame:
    """The full result of a method for all pairs of a channel of x and a channel of y, two members of any rates."""
    samples, sr = pairs.matched(s, modality_x, modality_y, channels_x, channels_y, match)
    if name in ("dtf", "pdc"):
        rows = method(name).run(pairs.one_recording_a_pair(samples), sr, **args).where("source != target")
        return rows.withColumn("recording", F.lit(f"{modality_x}|{modality_y}"))
    return pairs.between(method(name).run(samples, sr, **args))


def coupling_matrix_between(s: SignalSet, modality_x: str, modality_y: str, name: str = "coherence", channels_x: list[str] | None = None, channels_y: list[str] | None = None, match: str = "butter", **args) -> DataFrame:
    """Rows (recording, channel_x, channel_y, value): `coupling_between` summed up."""
    m = method(name)
    rows = coupling_between(s, modality_x, modality_y, name, channels_x, channels_y, match, **args)
    return pairs.between(m.scalar(rows)) if name in ("dtf", "pdc") else m.scalar(rows)


def statistic(name: str, sr: float, **args) -> Callable[[np.ndarray, np.ndarray], float]:
    """The scalar of two arrays, for surrogate_test and bootstrap_ci; offered for every method."""
    f = method(name).stat
    return lambda x, y: f(x, y, sr, **args)


def fingerprint(samples: DataFrame) -> str:
    """A number that changes with the data: count and order-free hash sum in one pass."""
    row = samples.agg(F.count("*"), F.sum(F.xxhash64(*sorted(samples.columns)).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def coupling_analysis_cached(s: SignalSet, modality: str, sr: float, name: str = "coherence", **args) -> tuple[DataFrame, SignalSet, bool]:
    """(result, set that remembers it, whether it was remembered). The key holds the arguments and the data's fingerprint."""
    samples = s.samples.where(F.col("modality") == modality).withColumnRenamed("modality", "recording")
    key = hashlib.md5(json.dumps([name, modality, sr, args, fingerprint(samples)], sort_keys=True, default=str).encode()).hexdigest()
    if key in s.results:
        return s.results[key], s, True
    result = coupling_analysis(samples, sr, name, **args).persist()
    return result, s.with_result(key, result), False


__all__ = ["METHODS", "coupling_analysis", "coupling_analysis_cached", "coupling_between", "coupling_matrix_between", "coupling_matrix", "fingerprint", "method", "statistic"]
