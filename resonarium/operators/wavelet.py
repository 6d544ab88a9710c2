"""Time-frequency coupling: chunks with halos, transformed once a channel for all frequencies and pairs; tall rows out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonarium.functions import spectra
from resonarium.functions.resampling import rng_of
from resonarium.operators.packed import map_groups, map_rows, ordered_pairs, pack
from resonarium.session import ship

PAIR = ["recording", "channel_x", "channel_y"]
#: Samples in a chunk, or four halos where these are longer.
CHUNK = 65_536
#: Standard deviations after which a wavelet counts as over (1e-14 of its height).
REACH = 8
#: Signals up to which their lengths are broadcast.
BROADCAST_SIGNALS = 100_000


def _by_frequency(samples: DataFrame, frequencies) -> DataFrame:
    """Each (pair, frequency) as a row, so that wide frequency lists spread over tasks."""
    f = [float(v) for v in (range(1, 41) if frequencies is None else frequencies)]
    pairs = ordered_pairs(pack(samples), ["x"])
    return pairs.select(*PAIR, "x_x", "x_y", F.explode(F.array(*map(F.lit, f))).alias("frequency"))


def coi(idx: Column, n: Column, sr: float, n_cycles: float = 7) -> Column:
    """Lowest frequency free of edge effects at a sample."""
    edge = F.greatest(F.least(idx, n - 1 - idx) / sr, F.lit(1 / sr))
    return math.sqrt(2) * n_cycles / (2 * math.pi * edge)


def _tall(rows: DataFrame, names: list[str], sr: float, first: int) -> DataFrame:
    tall = rows.select(*PAIR, "frequency", F.posexplode(F.arrays_zip(*names)).alias("idx", "z"), F.size(names[0]).alias("_n"))
    return tall.select(*PAIR, "frequency", "idx", ((F.col("idx") + first) / sr).alias("time"), *(F.col(f"z.{c}").alias(c) for c in names), "_n")


def chunk_pairs(samples: DataFrame, sr: float, frequencies: list[float], n_cycles: float, smoothing_cycles: float | None, kernel: Callable, names: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows (pair, frequency, idx, names..., _n): kernel's arrays for every pair of a recording's channels.

    Signals are cut into chunks with halos as long as the slowest wavelet and its
    smoothing; all channels of a chunk are one row. So the samples are moved
    twice, however many frequencies and pairs there are, and each channel of a
    chunk is transformed once. kernel(f, a, b, smooth, row) gets the two wavelet
    transforms over the chunk and what the smoothing of it needs on each side.
    Samples are those from idx 0 without gaps; a pair is as long as its shorter
    channel.
    """
    ship(samples.sparkSession)
    slow = min(frequencies)
    wave = lambda f: math.ceil(REACH * n_cycles / (2 * math.pi * f) * sr)
    flat = lambda f: math.ceil(3 * smoothing_cycles / f * sr) if smoothing_cycles else 0
    halo = wave(slow) + flat(slow)
    size = max(chunk, 4 * halo)
    sized = samples.groupBy("recording", "channel").agg((F.max("idx") + 1).alias("n"))
    if sized.count() <= BROADCAST_SIGNALS:
        sized = F.broadcast(sized)
    at = F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - halo) / size)), F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("idx") + halo) / size)))
    rows = samples.join(sized, ["recording", "channel"]).select("recording", "channel", "n", "idx", F.col("value").cast("double").alias("value"), F.explode(at).alias("chunk"))
    rows = rows.groupBy("recording", "channel", "n", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    rows = rows.groupBy("recording", "chunk").agg(F.array_sort(F.collect_list(F.struct("channel", "n", F.col("s.value").alias("x")))).alias("c"))
    rows = rows.where(F.size("c") > 1).select("recording", "chunk", F.col("c.channel").alias("channels"), F.col("c.n").alias("ns"), F.transform("c", lambda c: F.size(c["x"])).alias("sizes"), F.flatten("c.x").alias("x"))

    def run(recording, chunk, channels, ns, sizes, x):
        ns, first = ns.astype(int), chunk * size
        cuts = np.concatenate([[0], np.cumsum(sizes.astype(int))])
        begin, end = max(0, first - halo), first + size + halo
        spectra_of: dict = {}

        def transformed(i: int, n: int, f: float, lo: int, hi: int) -> np.ndarray:
            """The wavelet transform of channel i, cut to n samples, from lo to hi."""
            own = spectra_of.get((i, n))
            if own is None:
                v = x[cuts[i] : cuts[i + 1]][: max(0, min(n, end) - begin)]
                points = 1 << math.ceil(math.log2(max(2, len(v) + wave(slow))))
                own = spectra_of[i, n] = np.fft.fft(v, points)
            points = len(own)
            nu = np.arange(points) * sr / points
            gain = np.where(nu > sr / 2, 0.0, np.exp(-0.5 * ((nu - f) / (f / n_cycles)) ** 2))
            return np.fft.ifft(own * gain)[lo - begin : hi - begin]

        for f in frequencies:
            kept: dict = {}
            for i in range(len(channels)):
                for j in range(i + 1, len(channels)):
                    n = min(ns[i], ns[j])
                    if first >= n:
                        continue
                    k = spectra.time_kernel(f, sr, smoothing_cycles, n) if smoothing_cycles else np.ones(1)
                    half = len(k) // 2
                    last = min(n, first + size)
                    lo, hi = max(0, first - half), min(n, last + half)
                    for c in (i, j):
                        if (c, n) not in kept:
                            kept[c, n] = transformed(c, n, f, lo, hi)

                    def smooth(z, k=k, half=half, lo=lo, hi=hi, n=n, last=last):
                        """z over lo to hi, mirrored at the signal's own ends, smoothed over the chunk."""
                        left, right = half - (first - lo), half - (hi - last)
                        full = np.concatenate([z[:left][::-1], z, z[len(z) - right :][::-1]])
                        points = 1 << math.ceil(math.log2(max(2, len(full) + len(k))))
                        out = np.fft.ifft(np.fft.fft(full, points) * np.fft.fft(k, points))[2 * half : 2 * half + last - first]
                        return out if np.iscomplexobj(z) else out.real

                    got = kernel(f, kept[i, n], kept[j, n], smooth)
                    yield {"channel_x": channels[i], "channel_y": channels[j], "frequency": f, "first": first, "_n": int(n)} | got

    fields = "channel_x string, channel_y string, frequency double, first long, _n long, " + ", ".join(f"{n} array<double>" for n in names)
    made = map_groups(rows, run, fields, ["recording"], names, 4)
    made = made.select(*PAIR, "frequency", "first", "_n", F.posexplode(F.arrays_zip(*names)).alias("i", "z"))
    return made.select(*PAIR, "frequency", (F.col("first") + F.col("i")).alias("idx"), *(F.col(f"z.{c}").alias(c) for c in names), "_n")


def split(frequencies, sr: float, n_cycles: float) -> tuple[list[float], list[float]]:
    """Frequencies whose wavelets fade within their halo, and those too near half the rate, whose cut-off spectrum rings on."""
    f = [float(v) for v in (range(1, 41) if frequencies is None else frequencies)]
    fades = lambda v: v > 0 and (sr / 2 - v) >= REACH * v / n_cycles and n_cycles >= REACH - 1
    return [v for v in f if fades(v)], [v for v in f if not fades(v)]


def _both_ways(samples, sr, frequencies, n_cycles, smoothing_cycles, kernel, whole, names, first, chunk) -> DataFrame:
    """Chunks for the frequencies that allow it, one row a pair and frequency for the rest."""
    short, long = split(frequencies, sr, n_cycles)
    out = None
    if short:
        out = chunk_pairs(samples, sr, short, n_cycles, smoothing_cycles, kernel, names, chunk)
        out = out.select(*PAIR, "frequency", "idx", ((F.col("idx") + first) / sr).alias("time"), *names, "_n")
    if long:
        rest = _tall(map_rows(_by_frequency(samples, long), whole, ", ".join(f"{n} array<double>" for n in names), [*PAIR, "frequency"], 8), names, sr, first)
        rest = rest.withColumns({"idx": F.col("idx").cast("long"), "_n": F.col("_n").cast("long")})
        out = rest if out is None else out.unionByName(rest)
    return out.withColumn("coi", coi(F.col("idx"), F.col("_n"), sr, n_cycles)).drop("_n")


def wavelet_coherence(samples: DataFrame, sr: float, frequencies=None, n_cycles: float = 7, smoothing_cycles: float = 3, chunk: int = CHUNK) -> DataFrame:
    """Rows (recording, channel_x, channel_y, frequency, idx, time, coherence, phase, coi)."""

    def in_chunk(f, a, b, smooth):
        cross, den = smooth(a * b.conj()), smooth(np.abs(a) ** 2) * smooth(np.abs(b) ** 2)
        value = np.where(den <= np.finfo(float).eps, 0, np.abs(cross) ** 2 / np.where(den > 0, den, 1))
        return {"coherence": np.clip(value, 0, 1), "phase": np.angle(cross)}

    def whole(x_x, x_y, frequency, **_):
        got = spectra.wavelet_coherence(x_x, x_y, sr, [frequency], n_cycles, smoothing_cycles)
        return {"coherence": got["coherence"][0], "phase": got["phase"][0]}

    return _both_ways(samples, sr, frequencies, n_cycles, smoothing_cycles, in_chunk, whole, ["coherence", "phase"], 0, chunk)


def wavelet_plv(samples: DataFrame, sr: float, frequencies=None, n_cycles: float = 7, smoothing_cycles: float = 3, chunk: int = CHUNK) -> DataFrame:
    """Rows (recording, channel_x, channel_y, frequency, idx, time, plv, coi)."""

    def in_chunk(f, a, b, smooth):
        return {"plv": np.clip(np.abs(smooth(np.exp(1j * (np.angle(a) - np.angle(b))))), 0, 1)}

    def whole(x_x, x_y, frequency, **_):
        return {"plv": spectra.wavelet_plv(x_x, x_y, sr, [frequency], n_cycles, smoothing_cycles)["plv"][0]}

    return _both_ways(samples, sr, frequencies, n_cycles, smoothing_cycles, in_chunk, whole, ["plv"], 0, chunk)


def cross_wavelet(samples: DataFrame, sr: float, frequencies=None, n_cycles: float = 7, n_surrogates: int = 100, siglvl: float = 0.95, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows (.., frequency, idx, time, power, phase, re, im, coi, level, significant); level: mean over memory-one noises of their quantile."""

    def told(c):
        return {"power": np.abs(c), "phase": np.angle(c), "re": c.real, "im": c.imag}

    def whole(x_x, x_y, frequency, **_):
        return told(spectra.cross_wavelet(x_x, x_y, sr, [frequency], n_cycles)["cross"][0])

    names = ["power", "phase", "re", "im"]
    tall = _both_ways(samples, sr, frequencies, n_cycles, None, lambda f, a, b, _: told(a * b.conj()), whole, names, 1, chunk)
    if not n_surrogates:
        return tall
    f = [float(v) for v in (range(1, 41) if frequencies is None else frequencies)]
    reps = ordered_pairs(pack(samples), ["x"]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_surrogates - 1))))

    def level(x_x, x_y, rep, **_):
        q = spectra.cross_wavelet_level(x_x, x_y, sr, f, n_cycles, siglvl, rng_of(seed, rep))
        return [{"frequency": a, "q": b} for a, b in zip(f, q)]

    levels = map_rows(reps, level, "frequency double, q double", PAIR).groupBy(*PAIR, "frequency").agg(F.avg("q").alias("level"))
    return tall.join(levels, [*PAIR, "frequency"]).withColumn("significant", F.col("power") > F.col("level"))
