"""Spectra of tall samples: segments once for each channel, sums over segments in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions import filters, spectra
from resonarium.operators.packed import map_rows, ordered_pairs, pack


def lengths(samples: DataFrame, common: bool) -> DataFrame:
    """Rows (recording, channel, n): each channel's number of samples, or that of its recording's shortest channel."""
    n = samples.groupBy("recording", "channel").agg((F.max("idx") + 1).alias("n"))
    return n.withColumn("n", F.min("n").over(Window.partitionBy("recording"))) if common else n


def segment_spectra(samples: DataFrame, nperseg: int = 256, noverlap: int | None = None, win="hann", demean: bool = False, common: bool = True) -> DataFrame:
    """Rows (recording, channel, seg, size, energy, re, im): half spectra of complete windowed segments, their length and the window's sum of squares.

    Samples are sent to the segments that own them, so a long signal is spread
    over its segments. A signal shorter than nperseg is one segment of its own
    length. common: channels of a recording are cut to the shortest first, as
    pairs of them need.
    """
    step = nperseg - (nperseg // 2 if noverlap is None else min(noverlap, nperseg - 1))
    idx, short = F.col("idx"), F.col("n") < nperseg
    rows = samples.join(lengths(samples, common), ["recording", "channel"]).where(idx < F.col("n")).withColumn("size", F.least(F.lit(nperseg), F.col("n")).cast("int"))
    first = F.when(short, 0).otherwise(F.greatest(F.lit(0), F.ceil((idx - nperseg + 1) / step))).cast("long")
    last = F.when(short, 0).otherwise(F.floor(idx / step)).cast("long")
    owned = rows.withColumn("seg", F.explode(F.sequence(first, last)))
    rows = owned.groupBy("recording", "channel", "seg", "size").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("value").alias("v")))).alias("_s")).where(F.size("_s") == F.col("size"))
    known: dict[int, np.ndarray] = {}

    def kernel(recording, channel, seg, size, x):
        w = known.setdefault(len(x), filters.window(win, len(x)))
        z = np.fft.rfft((x - x.mean() if demean else x) * w)
        return {"energy": float((w**2).sum()), "re": z.real, "im": z.imag}

    return map_rows(rows.select("recording", "channel", "seg", "size", F.col("_s.v").alias("x")), kernel, "energy double, re array<double>, im array<double>", ["recording", "channel", "seg", "size"])


def _last_bin() -> Column:
    return F.floor(F.col("size") / 2)


def _density(sr: float) -> Column:
    """What makes a mean of products a one-sided density: bins between the first and the last count twice."""
    twice = F.when((F.col("bin") == 0) | (F.col("bin") == _last_bin()), 1.0).otherwise(2.0)
    return F.coalesce(F.try_divide(twice, sr * F.col("energy")), F.lit(0.0))


def _frequency(sr: float) -> Column:
    return F.coalesce(F.try_divide(F.col("bin") * (sr / 2), _last_bin()), F.lit(0.0))


def welch_psd(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, win="hann") -> DataFrame:
    """Rows (recording, channel, bin, frequency, psd)."""
    s = segment_spectra(samples, nperseg, noverlap, win, common=False)
    rows = s.select("recording", "channel", "size", "energy", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("bin", "p"))
    rows = rows.groupBy("recording", "channel", "bin").agg(F.avg("p").alias("p"), F.max("size").alias("size"), F.max("energy").alias("energy"))
    return rows.select("recording", "channel", "bin", _frequency(sr).alias("frequency"), (F.col("p") * _density(sr)).alias("psd"))


def pair_sums(s: DataFrame) -> DataFrame:
    """Rows (recording, channel_x, channel_y, bin, n, size, energy, re, im, xx, yy): means over segments for all pairs, from spectra made once a channel."""
    pairs = ordered_pairs(s, ["re", "im", "size", "energy"], ["recording", "seg"])
    zipped = F.arrays_zip("re_x", "im_x", "re_y", "im_y")
    rows = pairs.select("recording", "channel_x", "channel_y", "size_x", "energy_x", F.posexplode(zipped).alias("bin", "z"))
    a, b, c, d = (F.col(f"z.{k}") for k in ("re_x", "im_x", "re_y", "im_y"))
    return rows.groupBy("recording", "channel_x", "channel_y", "bin").agg(
        F.count("*").alias("n"), F.max("size_x").alias("size"), F.max("energy_x").alias("energy"),
        F.avg(a * c + b * d).alias("re"), F.avg(b * c - a * d).alias("im"), F.avg(a * a + b * b).alias("xx"), F.avg(c * c + d * d).alias("yy"),
    )


def cross_spectrum(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, win="hann") -> DataFrame:
    """Rows (recording, channel_x, channel_y, bin, frequency, re, im, magnitude, phase)."""
    rows = pair_sums(segment_spectra(samples, nperseg, noverlap, win)).withColumn("k", _density(sr)).withColumn("re", F.col("re") * F.col("k")).withColumn("im", F.col("im") * F.col("k"))
    return rows.select("recording", "channel_x", "channel_y", "bin", _frequency(sr).alias("frequency"), "re", "im", F.hypot("re", "im").alias("magnitude"), F.atan2("im", "re").alias("phase"))


def coherence_of(sums: DataFrame, kind: str = "magnitude") -> DataFrame:
    """sums with coherence and confidence; coherence is null where a channel has no power."""
    root = F.sqrt(F.col("xx") * F.col("yy"))
    re, im = F.col("re") / root, F.col("im") / root
    if kind == "magnitude":
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), re * re + im * im))
    elif kind == "imaginary":
        value = im
    elif kind == "lagged":
        value = im / F.sqrt(F.greatest(1 - re * re, F.lit(float(np.finfo(float).eps))))
    else:
        raise ValueError(f"unknown coherence {kind!r}")
    limit = F.when(F.col("n") <= 1, 1.0).otherwise(1 - F.pow(F.lit(0.05), 1 / F.greatest(F.col("n") - 1, F.lit(1))))
    return sums.withColumn("coherence", F.when(root > 0, value)).withColumn("confidence", limit)


def coherence(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, kind: str = "magnitude", freq_range: tuple[float, float] | None = None, method: str = "welch") -> DataFrame:
    """Rows (recording, channel_x, channel_y, bin, frequency, coherence, confidence) for every pair of channels."""
    if method != "welch":
        raise ValueError("only welch is offered here; see multitaper_coherence")
    rows = coherence_of(pair_sums(segment_spectra(samples, nperseg, noverlap)), kind).withColumn("frequency", _frequency(sr))
    if freq_range is not None:
        rows = rows.where(F.col("frequency").between(*freq_range))
    return rows.select("recording", "channel_x", "channel_y", "bin", "frequency", "coherence", "confidence")


def lagged_coherence(samples: DataFrame, sr: float, **how) -> DataFrame:
    return coherence(samples, sr, kind="lagged", **how)


def coherence_matrix(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, freq_range=None) -> DataFrame:
    """Rows (recording, channel_x, channel_y, peak, peak_frequency)."""
    rows = coherence(samples, sr, nperseg, noverlap, freq_range=freq_range)
    best = F.struct(F.abs("coherence").alias("v"), (-F.col("bin")).alias("b"))
    return rows.groupBy("recording", "channel_x", "channel_y").agg(F.max(F.abs("coherence")).alias("peak"), F.max_by("frequency", best).alias("peak_frequency"))


def coherence_spectra(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, kind: str = "magnitude", freq_range=None) -> DataFrame:
    """Rows (recording, channel_x, channel_y, peak, peak_frequency, spectrum): the matrix of peaks with the spectrum behind each.

    spectrum: array of (bin, frequency, coherence, confidence) in order of bin. It
    comes from the same aggregation as the peak, a row a pair.
    """
    rows = coherence(samples, sr, nperseg, noverlap, kind, freq_range)
    best = F.struct(F.abs("coherence").alias("v"), (-F.col("bin")).alias("b"))
    spectrum = F.array_sort(F.collect_list(F.struct("bin", "frequency", "coherence", "confidence")))
    return rows.groupBy("recording", "channel_x", "channel_y").agg(F.max(F.abs("coherence")).alias("peak"), F.max_by("frequency", best).alias("peak_frequency"), spectrum.alias("spectrum"))


def phase_slope_index(samples: DataFrame, sr: float, band: tuple[float, float], nperseg: int = 256, noverlap: int | None = None, normalize: bool = True) -> DataFrame:
    """Rows (recording, channel_x, channel_y, psi); above 0 where x leads, null where a channel has no power in a bin of the band."""
    if band[0] >= band[1]:
        raise ValueError("the band's lower edge must be below the upper one")
    rows = pair_sums(segment_spectra(samples, nperseg, noverlap)).withColumn("frequency", _frequency(sr)).where(F.col("frequency").between(*band))
    root, dead = F.sqrt(F.col("xx") * F.col("yy")), F.lit(float("nan"))
    rows = rows.select("recording", "channel_x", "channel_y", "bin", F.when(root > 0, F.col("re") / root).otherwise(dead).alias("re"), F.when(root > 0, F.col("im") / root).otherwise(dead).alias("im"))
    w = Window.partitionBy("recording", "channel_x", "channel_y").orderBy("bin")
    rows = rows.withColumn("re2", F.lead("re").over(w)).withColumn("im2", F.lead("im").over(w)).where("re2 is not null")
    # the phase of x times conjugate y rises with frequency where x leads
    num = F.sum(F.col("re") * F.col("im2") - F.col("im") * F.col("re2"))
    den = F.sum(F.hypot("re", "im") * F.hypot("re2", "im2"))
    return rows.groupBy("recording", "channel_x", "channel_y").agg((F.try_divide(num, den) if normalize else num).alias("psi")).withColumn("psi", F.when(~F.isnan("psi"), F.col("psi")))


def multitaper_psd(samples: DataFrame, sr: float, nw: float = 4, k: int | None = None) -> DataFrame:
    def kernel(recording, channel, x):
        f, p = spectra.multitaper_psd(x, sr, nw, k)
        return {"frequencies": f, "psd": p}

    return map_rows(pack(samples), kernel, "frequencies array<double>, psd array<double>", ["recording", "channel"])


def multitaper_coherence(samples: DataFrame, sr: float, nw: float = 4, k: int | None = None, freq_range=None) -> DataFrame:
    def kernel(x_x, x_y, **_):
        got = spectra.multitaper_coherence(x_x, x_y, sr, nw, k, freq_range)
        return {"frequency": got["frequencies"], "coherence": got["coherence"], "confidence": got["confidence"]}

    rows = map_rows(ordered_pairs(pack(samples), ["x"]), kernel, "frequency array<double>, coherence array<double>, confidence double", ["recording", "channel_x", "channel_y"])
    return rows.select("recording", "channel_x", "channel_y", "confidence", F.posexplode(F.arrays_zip("frequency", "coherence")).alias("bin", "z")).select("recording", "channel_x", "channel_y", "bin", "z.frequency", "z.coherence", "confidence")
