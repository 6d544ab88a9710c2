"""Phase-amplitude coupling: banks of phases and envelopes made once, grids by grouping."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonarium.functions import filters, resampling
from resonarium.operators.packed import map_rows, pack
from resonarium.session import ship

METHODS = ("tort", "canolty", "ozkurt", "plv")


def check_frequencies(f, name: str) -> list[float]:
    f = [float(v) for v in f]
    if not f or any(not math.isfinite(v) for v in f) or any(b <= a for a, b in zip(f, f[1:])):
        raise ValueError(f"{name} must be finite and strictly increasing")
    return f


def bands_of(centres, width: float, sr: float) -> list[tuple[float, float, float]]:
    """(centre, low, high) clamped to (0.5 Hz or 1 % of half the rate, half the rate less 0.5 Hz or 99 % of it); distinct."""
    nyq = sr / 2
    low, high = max(0.5, 0.01 * nyq), min(nyq - 0.5, 0.99 * nyq)
    out = [(c, max(low, c - width / 2), min(high, c + width / 2)) for c in check_frequencies(centres, "frequencies")]
    if any(not 0 < a < b < nyq for _, a, b in out):
        raise ValueError("a band lies outside of (0, half the rate)")
    if len({(a, b) for _, a, b in out}) < len(out):
        raise ValueError("bands coincide after clamping")
    return out


def slow_phase(x: np.ndarray, low: float, high: float, slow: tuple[float, float], sr: float, order: int, kind: str) -> np.ndarray:
    """Phase of the part of an envelope that lies in the band `slow`."""
    env = np.abs(filters.band_analytic(x, low, high, sr, order, kind))
    return np.angle(filters.band_analytic(env - env.mean(), float(slow[0]), float(slow[1]), sr, order, kind))


def bank(packed: DataFrame, bands: list[tuple[float, float, float]], sr: float, what: str, order: int = 4, kind: str = "butter", keep: list[str] = ("recording", "channel"), slow: tuple[float, float] | None = None) -> DataFrame:
    """Rows (keep, centre, idx, v): phase, envelope, or slow (the phase of the envelope's part in the band `slow`) of each band. Each (signal, band) is a row of its own for the kernel."""
    spec = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("c"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for c, a, b in bands))).alias("band")

    def kernel(x, centre, low, high, **_):
        if what == "slow":
            return {"v": slow_phase(x, low, high, slow, sr, order, kind)}
        z = filters.band_analytic(x, low, high, sr, order, kind)
        return {"v": np.angle(z) if what == "phase" else np.abs(z)}

    rows = packed.select(*keep, "x", spec).select(*keep, "x", F.col("band.c").alias("centre"), F.col("band.a").alias("low"), F.col("band.b").alias("high"))
    return map_rows(rows, kernel, "v array<double>", [*keep, "centre"]).select(*keep, "centre", F.posexplode("v").alias("idx", "v"))


def phase_bin(phase: Column, n_bins: int) -> Column:
    """Number of the equal bin of [-pi, pi] that holds a phase: right-closed, the first also closed at the left."""
    return F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.ceil((phase + math.pi) / (2 * math.pi / n_bins)).cast("int") - 1))


def tort(rows: DataFrame, keys: list[str], n_bins: int = 18) -> DataFrame:
    """Modulation index from rows (keys, phase, amp)."""
    means = rows.groupBy(*keys, phase_bin(F.col("phase"), n_bins).alias("bin")).agg(F.avg("amp").alias("m"))
    # sum p log p = (sum m log m) / total - log total over bins that are not empty
    sums = means.groupBy(*keys).agg(F.sum("m").alias("total"), F.sum(F.when(F.col("m") > 0, F.col("m") * F.log("m")).otherwise(0.0)).alias("mlogm"))
    mi = (math.log(n_bins) + F.col("mlogm") / F.col("total") - F.log("total")) / math.log(n_bins)
    return sums.select(*keys, F.when(F.col("total") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mi))).otherwise(0.0).alias("pac"))


def distribution(rows: DataFrame, keys: list[str], n_bins: int = 18) -> DataFrame:
    """Rows (keys, bin, centre, share): the mean amplitude of each phase bin as a share of all."""
    means = rows.groupBy(*keys, phase_bin(F.col("phase"), n_bins).alias("bin")).agg(F.avg("amp").alias("m"))
    total = means.groupBy(*keys).agg(F.sum("m").alias("total"))
    return means.join(total, list(keys)).select(*keys, "bin", (-math.pi + (F.col("bin") + 0.5) * (2 * math.pi / n_bins)).alias("centre"), F.when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(1 / n_bins).alias("share"))


def strength(rows: DataFrame, keys: list[str], method: str = "tort", n_bins: int = 18) -> DataFrame:
    """Rows (keys, pac) from rows (keys, phase, amp); for plv amp is the phase of the envelope's slow part."""
    if method == "tort":
        return tort(rows, keys, n_bins)
    re, im = F.avg(F.col("amp") * F.cos("phase")), F.avg(F.col("amp") * F.sin("phase"))
    if method == "canolty":
        value = F.hypot(re, im)
    elif method == "ozkurt":
        den = F.sqrt(F.avg(F.col("amp") ** 2))
        value = F.when(den > 0, F.hypot(re, im) / den).otherwise(0.0)
    elif method == "plv":
        d = F.col("phase") - F.col("amp")
        value = F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.groupBy(*keys).agg(value.alias("pac"))


def comodulogram(samples_x: DataFrame, samples_y: DataFrame, sr: float, phase_freqs, amp_freqs, phase_bw: float = 2, amp_bw: float = 10, method: str = "tort", n_bins: int = 18, order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (phase_freq, amp_freq, pac): the phase of x against the envelope of y; pass one frame twice for one signal.

    Each frame holds one signal. The two banks meet on the sample index.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    p, a = bands_of(phase_freqs, phase_bw, sr), bands_of(amp_freqs, amp_bw, sr)
    one = lambda df: pack(df.select(F.lit(0).alias("k"), "idx", "value"), ["k"])
    if method == "plv":
        return _grid_plv(one(samples_x), one(samples_y), p, a, sr, order, kind)
    phases = bank(one(samples_x), p, sr, "phase", order, kind, ["k"]).select("idx", F.col("centre").alias("phase_freq"), F.col("v").alias("phase"))
    amps = bank(one(samples_y), a, sr, "envelope", order, kind, ["k"]).select("idx", F.col("centre").alias("amp_freq"), F.col("v").alias("amp"))
    return strength(phases.join(amps, "idx"), ["phase_freq", "amp_freq"], method, n_bins)


def _grid_plv(x: DataFrame, y: DataFrame, p, a, sr, order, kind) -> DataFrame:
    def kernel(x, y):
        out = []
        for pc, pl, ph in p:
            phi = np.angle(filters.band_analytic(x, pl, ph, sr, order, kind))
            for ac, al, ah in a:
                env = np.abs(filters.band_analytic(y, al, ah, sr, order, kind))
                psi = np.angle(filters.band_analytic(env - env.mean(), pl, ph, sr, order, kind))
                out.append({"phase_freq": pc, "amp_freq": ac, "pac": abs(np.exp(1j * (phi - psi)).mean())})
        return out

    rows = x.crossJoin(y.select(F.col("x").alias("y"))).select("x", "y")  # one signal each
    return map_rows(rows, kernel, "phase_freq double, amp_freq double, pac double")


def phase_amplitude_coupling(samples_x: DataFrame, samples_y: DataFrame, sr: float, phase_band=(4, 8), amp_band=(30, 80), method: str = "tort", n_bins: int = 18, order: int = 4, kind: str = "butter") -> DataFrame:
    """One row (pac)."""
    filters.check_band(*phase_band, sr)
    filters.check_band(*amp_band, sr)
    mid = lambda b: [(sum(b) / 2, float(b[0]), float(b[1]))]
    one = lambda df: pack(df.select(F.lit(0).alias("k"), "idx", "value"), ["k"])
    if method == "plv":
        return _grid_plv(one(samples_x), one(samples_y), mid(phase_band), mid(amp_band), sr, order, kind).select("pac")
    phases = bank(one(samples_x), mid(phase_band), sr, "phase", order, kind, ["k"]).select("idx", F.col("v").alias("phase"))
    amps = bank(one(samples_y), mid(amp_band), sr, "envelope", order, kind, ["k"]).select("idx", F.col("v").alias("amp"))
    return strength(phases.join(amps, "idx").withColumn("k", F.lit(0)), ["k"], method, n_bins).select("pac")


def peak(grid: DataFrame) -> DataFrame:
    """The cell of the largest value; among equals the one of least amplitude frequency, then of least phase frequency."""
    return grid.agg(F.max_by(F.struct("phase_freq", "amp_freq", "pac"), F.struct("pac", -F.col("amp_freq"), -F.col("phase_freq"))).alias("p")).select("p.*")


def grid_arrays(x: np.ndarray, y: np.ndarray, p, a, sr: float, method: str, n_bins: int, order: int, kind: str) -> np.ndarray:
    """Values of a whole grid (phase x amplitude) from arrays, for replicates."""
    phases = [np.angle(filters.band_analytic(x, lo, hi, sr, order, kind)) for _, lo, hi in p]
    amps = np.stack([np.abs(filters.band_analytic(y, lo, hi, sr, order, kind)) for _, lo, hi in a])
    out = np.zeros((len(p), len(a)))
    for i, phi in enumerate(phases):
        if method == "tort":
            k = np.clip(np.ceil((phi + np.pi) / (2 * np.pi / n_bins)).astype(int) - 1, 0, n_bins - 1)
            n = np.bincount(k, minlength=n_bins)
            m = np.stack([np.bincount(k, v, n_bins) for v in amps]) / np.maximum(n, 1)
            total = m.sum(1, keepdims=True)
            q = m / np.where(total > 0, total, 1)
            out[i] = np.where(total[:, 0] > 0, np.clip((np.log(n_bins) + np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(1)) / np.log(n_bins), 0, 1), 0)
        else:
            z = np.abs((amps * np.exp(1j * phi)).mean(1))
            if method == "ozkurt":
                den = np.sqrt((amps**2).mean(1))
                z = np.where(den > 0, z / np.where(den > 0, den, 1), 0)
            out[i] = z
    return out


def modulation_index(samples_x: DataFrame, samples_y: DataFrame, sr: float, phase_freqs, amp_freqs, phase_bw: float = 2, amp_bw: float = 10, method: str = "tort", n_bins: int = 18, n_surrogates: int = 199, surrogate: str = "timeshift", p_adjust: str = "BH", alpha: float = 0.05, seed: int = 0, order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (phase_freq, amp_freq, pac, p_value, p_adjusted, threshold, null_mean, null_sd, significant).

    One surrogate of y a replicate serves the whole grid. Each replicate is a row
    that carries its seed and both signals, so what is sent grows with the
    replicates; both signals must fit a task. Draws depend on (seed, replicate)
    alone.
    """
    if method not in METHODS[:3]:
        raise ValueError(f"method must be one of {METHODS[:3]}")
    if not (n_surrogates == 0 or n_surrogates >= math.ceil(1 / alpha)):
        raise ValueError("n_surrogates must be 0 or at least 1 / alpha")
    if surrogate not in resampling.SURROGATES:
        raise ValueError(f"unknown surrogate {surrogate!r}")
    p, a = bands_of(phase_freqs, phase_bw, sr), bands_of(amp_freqs, amp_bw, sr)
    spark = samples_x.sparkSession
    ship(spark)
    one = lambda df, name: pack(df.select(F.lit(0).alias("k"), "idx", "value"), ["k"], name=name)
    reps = spark.range(-1, n_surrogates).select(F.col("id").alias("rep"))
    # the pair is one row, of which every replicate gets a copy
    rows = reps.repartition(max(1, min(n_surrogates + 1, 4 * spark.sparkContext.defaultParallelism)), "rep").crossJoin(one(samples_x, "x").join(one(samples_y, "y"), "k").select("x", "y"))

    def kernel(rep, x, y):
        moved = y if rep < 0 else resampling.SURROGATES[surrogate](y, resampling.rng_of(seed, rep))
        g = grid_arrays(x, moved, p, a, sr, method, n_bins, order, kind)
        return [{"phase_freq": p[i][0], "amp_freq": a[j][0], "pac": g[i, j]} for i in range(len(p)) for j in range(len(a))]

    cells = map_rows(rows, kernel, "phase_freq double, amp_freq double, pac double", ["rep"])
    key = ["phase_freq", "amp_freq"]
    cells = cells.groupBy(*key).agg(F.max(F.when(F.col("rep") < 0, F.col("pac"))).alias("pac"), F.sort_array(F.collect_list(F.when(F.col("rep") >= 0, F.col("pac")))).alias("null"))
    if n_surrogates == 0:
        return cells.select(*key, "pac")
    from resonarium.operators.inference import adjusted, quantile8

    stats = cells.select(
        *key, "pac", ((F.size(F.filter("null", lambda v: v >= F.col("pac"))) + 1) / (F.size("null") + 1)).alias("p_value"), quantile8(F.col("null"), 1 - alpha).alias("threshold"),
        (F.aggregate("null", F.lit(0.0), lambda s, v: s + v) / F.size("null")).alias("null_mean"), "null",
    )
    spread = F.sqrt(F.aggregate("null", F.lit(0.0), lambda s, v: s + (v - F.col("null_mean")) ** 2) / (F.size("null") - 1))
    stats = adjusted(stats.withColumn("null_sd", spread).drop("null"), "p_value", [], p_adjust)
    return stats.withColumn("significant", F.col("p_adjusted") <= alpha)
