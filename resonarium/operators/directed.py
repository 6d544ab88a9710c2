"""Directed coupling: lagged sums of products in Spark, small solves after."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions import directed as D
from resonarium.operators import neighbours
from resonarium.operators.packed import lists, map_groups, map_rows, ordered_pairs, pack
from resonarium.session import ship

PAIR = ["recording", "channel_x", "channel_y"]
#: Samples of all channels in a chunk, and sums in a row that travels, about.
CHUNK_NUMBERS, BLOCK_NUMBERS = 2_000_000, 1 << 18
#: Channels or recordings up to which their lengths and means are broadcast.
BROADCAST_ROWS = 100_000


def lag_features(samples: DataFrame, order: int) -> DataFrame:
    """Rows (recording, channel, idx, h): the demeaned value and its `order` predecessors, newest first; incomplete rows are gone."""
    keys = ["recording", "channel"]
    w = Window.partitionBy(*keys).orderBy("idx")
    d = samples.withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    h = F.array("d", *(F.lag("d", k).over(w) for k in range(1, order + 1)))
    return d.select(*keys, "idx", h.alias("h")).where(F.get("h", F.lit(order)).isNotNull())


def pair_grams(samples: DataFrame, order: int) -> DataFrame:
    """Rows (recording, channel_x, channel_y, n, g): sums of products of (x, its lags, y, its lags) for every pair, upper triangle by rows."""
    pairs = ordered_pairs(lag_features(samples, order), ["h"], ["recording", "idx"])
    m = 2 * (order + 1)
    z = F.concat("h_x", "h_y")
    rows = pairs.select(*PAIR, z.alias("z"))
    sums = [F.sum(F.get("z", F.lit(i)) * F.get("z", F.lit(j))).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    out = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), *sums)
    return out.select(*PAIR, "n", F.array(*(f"s{i}_{j}" for i in range(m) for j in range(i, m))).alias("g"))


def cross_spectra(samples: DataFrame, sr: float, estimator: str = "multitaper", n_fft: int | None = None, segment_length: int | None = None, overlap: float = 0.5, time_bandwidth: float = 4, n_tapers: int | None = None) -> DataFrame:
    """Rows (recording, channels, n, size, n_fft, realizations, re, im): one-sided spectral matrices of all channels, or (.., status) where they cannot be had.

    re, im: bins x channels x channels, averaged over segments and tapers; values
    are centred and brought to unit power a channel first. Each segment of all
    channels is one row and each channel of it is transformed once for each
    taper; a task adds up its segments before the sums travel.
    """
    ship(samples.sparkSession)
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    sized = samples.groupBy("recording", "channel").agg((F.max("idx") + 1).alias("n")).groupBy("recording").agg(F.min("n").alias("n"))

    def layout(n, **_):
        size = D.default_segment(n, overlap) if segment_length is None else int(segment_length)
        points = 1 << int(np.ceil(np.log2(max(2, size)))) if n_fft is None else int(n_fft)
        D.check_segments(n, size, points, overlap, estimator, time_bandwidth)
        return {"n": n, "size": size, "n_fft": points, "step": max(1, int(np.floor(size * (1 - overlap))))}

    table = map_rows(sized, layout, "n long, size int, n_fft int, step int, status string", ["recording"])
    cut = samples.select("recording", "channel", "idx", F.col("value").cast("double").alias("value")).join(small(table), "recording")
    good = cut.where((F.col("status") == "ok") & (F.col("idx") < F.col("n")))
    means = good.groupBy("recording", "channel").agg(F.avg("value").alias("mean"))
    centred = good.join(small(means), ["recording", "channel"]).withColumn("value", F.col("value") - F.col("mean"))
    scale = centred.groupBy("recording", "channel").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("scale"))
    rows = centred.join(small(scale), ["recording", "channel"]).withColumn("value", F.when(F.col("scale") > D.EPS, F.col("value") / F.col("scale")).otherwise(F.lit(float("nan"))))
    last = F.floor((F.col("n") - F.col("size")) / F.col("step"))
    to = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("idx") - F.col("size") + 1) / F.col("step"))), F.least(last, F.floor(F.col("idx") / F.col("step"))))
    inside = F.greatest(F.lit(0), F.ceil((F.col("idx") - F.col("size") + 1) / F.col("step"))) <= F.least(last, F.floor(F.col("idx") / F.col("step")))
    shape = ["recording", "n", "size", "n_fft"]
    rows = rows.where(inside).select(*shape, "channel", "idx", "value", F.explode(to).alias("seg"))
    rows = rows.groupBy(*shape, "channel", "seg").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    rows = rows.groupBy(*shape, "seg").agg(F.array_sort(F.collect_list(F.struct("channel", F.col("s.value").alias("x")))).alias("c"))
    rows = rows.select(*shape, F.col("c.channel").alias("channels"), F.flatten("c.x").alias("x"))

    def run(batches):
        from pyspark import TaskContext

        part, sums, about = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            for i in range(b.num_rows):
                recording, n, size, points, channels = (b.column(k)[i].as_py() for k in range(5))
                x = np.asarray(b.column(5)[i].values, float).reshape(len(channels), size)
                tapers = D.tapers_of(estimator, size, time_bandwidth, n_tapers)
                f = np.fft.fft((x - x.mean(1, keepdims=True))[:, None, :] * tapers, points)[..., : points // 2 + 1] / np.sqrt(sr * (tapers**2).sum(1))[None, :, None]
                sums[recording] = sums.get(recording, 0) + np.einsum("atf,btf->fab", f, f.conj())
                about[recording] = (channels, n, size, points, about.get(recording, (0,) * 5)[4] + len(tapers))
        for recording, s in sums.items():
            channels, n, size, points, count = about[recording]
            each = max(1, BLOCK_NUMBERS // (2 * len(channels) ** 2))
            for k in range(0, len(s), each):
                z = s[k : k + each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([recording]), pa.array([channels]), pa.array([n]), pa.array([size], pa.int32()), pa.array([points], pa.int32()), pa.array([k], pa.int64()), pa.array([part], pa.int32()), lists([np.concatenate([[float(count)], z.real.ravel(), z.imag.ravel()])])],
                    names=["recording", "channels", "n", "size", "n_fft", "row", "part", "g"],
                )

    parts = rows.mapInArrow(run, "recording string, channels array<string>, n long, size int, n_fft int, row long, part int, g array<double>")
    keys = ["recording", "channels", "n", "size", "n_fft"]
    total = summed(parts, [*keys, "row"], "g").select(*keys, "row", F.element_at("g", 1).cast("long").alias("realizations"), F.slice("g", F.lit(2), F.size("g") - 1).alias("g"))
    half = (F.size("g") / 2).cast("int")
    total = total.select(*keys, "row", "realizations", F.slice("g", F.lit(1), half).alias("re"), F.slice("g", half + 1, half).alias("im"))
    total = total.groupBy(*keys, "realizations").agg(F.array_sort(F.collect_list(F.struct("row", "re", "im"))).alias("s"))

    def averaged(n_fft, channels, realizations, re, im, **_):
        s = (re + 1j * im).reshape(n_fft // 2 + 1, len(channels), -1) / realizations
        s[1:-1] *= 2
        s = (s + s.conj().transpose(0, 2, 1)) / 2
        return [{"re2": s.real, "im2": s.imag}]

    flat = total.select(*keys, "realizations", F.flatten("s.re").alias("re"), F.flatten("s.im").alias("im"))
    out = map_groups(flat, averaged, "re2 array<double>, im2 array<double>", [*keys, "realizations"], ["re2", "im2"], 1).withColumnsRenamed({"re2": "re", "im2": "im"})
    bad = table.where("status != 'ok'").select("recording", "status")
    return out.withColumn("status", F.lit("ok")).unionByName(bad, allowMissingColumns=True)


def granger_spectra(samples: DataFrame, sr: float, freq_range: tuple[float, float] | None = None, tolerance: float = 1e-8, most: int = 1000, floor: float = 1e-10, **how) -> DataFrame:
    """The whole non-parametric result, a row a pair.

    Rows (recording, channel_x, channel_y, gc_xy, gc_yx, net_gc, frequencies,
    spectrum_xy, spectrum_yx, sigma_xx, sigma_xy, sigma_yy, iterations,
    reconstruction_error, realizations, segment_length, n_fft, status). The
    spectral matrices of all channels are made once (cross_spectra); a pair takes
    its part of them and factorizes that. sigma: covariance of the innovations of
    the signals at unit power. A status other than ok says why the rest is null.
    """
    spectra = cross_spectra(samples, sr, **how)
    named = samples.select("recording", "channel").distinct()
    x, y = named.withColumnRenamed("channel", "channel_x"), named.withColumnRenamed("channel", "channel_y")
    pairs = x.join(y, "recording").where("channel_x < channel_y")
    at = lambda c: F.array_position("channels", F.col(c)).cast("int") - 1
    c = F.size("channels")
    bins = F.sequence(F.lit(0), (F.col("n_fft") / 2).cast("int"))
    pick = lambda name, i, j: F.transform(bins, lambda b: F.get(name, (b * c + F.col(i)) * c + F.col(j)))
    met = pairs.join(spectra, "recording").withColumns({"i": at("channel_x"), "j": at("channel_y")})
    met = met.select(*PAIR, "n", "size", "n_fft", "realizations", "status", pick("re", "i", "i").alias("xx"), pick("re", "j", "j").alias("yy"), pick("re", "i", "j").alias("xy"), pick("im", "i", "j").alias("xyi"))

    def kernel(recording, channel_x, channel_y, n, size, n_fft, realizations, status, xx, yy, xy, xyi):
        if status != "ok":
            raise ValueError(status)
        if n < 32 or not np.isfinite(np.concatenate([xx, yy, xy, xyi])).all():
            raise ValueError("32 finite samples of signals that are not constant are needed")
        if realizations < 2:
            raise ValueError("two realizations are needed")
        z = np.asarray(xy) + 1j * np.asarray(xyi)
        s = np.stack([np.stack([xx + 0j, z], -1), np.stack([z.conj(), yy + 0j], -1)], -2)
        m, full = len(s), D.two_sided(D.regularized(s, floor))
        w = D.wilson(full, tolerance, most)
        a, b = D.geweke(full[:m], w["H"][:m], w["Sigma"])
        f = np.arange(m) * sr / n_fft
        band = (f[0], f[-1]) if freq_range is None else freq_range
        p, q = D.trapezoid_mean(a, f, band), D.trapezoid_mean(b, f, band)
        sigma = w["Sigma"]
        return {
            "gc_xy": p, "gc_yx": q, "net_gc": p - q, "frequencies": f, "spectrum_xy": a, "spectrum_yx": b, "sigma_xx": sigma[0, 0], "sigma_xy": sigma[0, 1], "sigma_yy": sigma[1, 1],
            "iterations": w["iterations"], "reconstruction_error": w["reconstruction_error"], "realizations": realizations, "segment_length": size, "n_fft": n_fft,
        }

    schema = "gc_xy double, gc_yx double, net_gc double, frequencies array<double>, spectrum_xy array<double>, spectrum_yx array<double>, sigma_xx double, sigma_xy double, sigma_yy double, iterations int, reconstruction_error double, realizations long, segment_length int, n_fft int, status string"
    return map_rows(met, kernel, schema, PAIR, 16)


def granger_causality(samples: DataFrame, sr: float, order: int = 5, freq_range: tuple[float, float] | None = None, method: str = "parametric", **how) -> DataFrame:
    """Rows (recording, channel_x, channel_y, gc_xy, gc_yx, net_gc, status).

    parametric: all pairs' lagged sums of products come from one aggregation;
    nonparametric: spectral factorization, of which granger_spectra gives all.
    """
    schema = "gc_xy double, gc_yx double, net_gc double, status string"
    if method == "nonparametric":
        found = granger_spectra(samples, sr, freq_range, **how)
        return found.select(*PAIR, "gc_xy", "gc_yx", "net_gc", "status")
    if method != "parametric":
        raise ValueError(f"unknown method {method!r}")
    m = 2 * (order + 1)
    upper = np.triu_indices(m)

    def kernel(g, n, **_):
        if n <= order + 1:
            raise ValueError("the signals are too short for this order")
        full = np.zeros((m, m))
        full[upper] = g
        full = full + np.triu(full, 1).T
        x, y = list(range(order + 1)), list(range(order + 1, m))
        take = lambda target, driver: full[np.ix_(target + driver[1:], target + driver[1:])]
        f = (lambda s: D.granger_from_gram(s, n, order)) if freq_range is None else (lambda s: D.spectral_granger_from_gram(s, n, order, sr, freq_range))
        xy, yx = f(take(y, x)), f(take(x, y))
        return {"gc_xy": xy, "gc_yx": yx, "net_gc": xy - yx}

    return map_rows(pair_grams(samples, order), kernel, schema, PAIR)


def summed(parts: DataFrame, keys: list[str], name: str, wide: int = 64) -> DataFrame:
    """Arrays added up by key, in two steps, so that no task gathers the parts of all tasks at once."""

    def add(_arrays, _width, **_):
        return [{name: _arrays.reshape(-1, int(_width)).sum(0)}]

    def step(rows: DataFrame, by: list[str]) -> DataFrame:
        met = rows.groupBy(*by).agg(F.flatten(F.collect_list(name)).alias("_arrays"), F.max(F.size(name)).alias("_width"))
        return map_groups(met, add, f"{name} array<double>", by, [name])

    return step(step(parts.withColumn("share", F.pmod("part", F.lit(wide))).drop("part"), [*keys, "share"]).drop("share"), keys)


def network_grams(samples: DataFrame, order: int, chunk_numbers: int = CHUNK_NUMBERS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """Rows (recording, channels, n, g, head): sums of products of all channels now and at `order` lags, over times from `order` on.

    n: samples a channel (the shortest one's); head: the first `order` samples,
    channel by channel, from which sums of lower orders follow. Time is cut into
    chunks with the `order` samples before them; a task adds up its chunks, and
    the sums travel in blocks of rows. The samples of all channels meet for a
    chunk only.
    """
    ship(samples.sparkSession)
    sized = samples.groupBy("recording", "channel").agg((F.max("idx") + 1).alias("n")).groupBy("recording").agg(F.min("n").alias("n"), F.count("*").alias("c"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    cut = samples.select("recording", "channel", "idx", F.col("value").cast("double").alias("value")).join(small(sized), "recording").where(F.col("idx") < F.col("n"))
    means = cut.groupBy("recording", "channel").agg(F.avg("value").alias("mean"))
    cut = cut.join(small(means), ["recording", "channel"]).withColumn("value", F.col("value") - F.col("mean"))
    size = F.greatest(F.lit(4 * order + 1), F.floor(F.lit(chunk_numbers) / F.col("c")))
    own = F.floor(F.col("idx") / size)
    to = F.sequence(own, F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("idx") + order) / size)))
    rows = cut.select("recording", "channel", "n", size.alias("size"), "idx", "value", F.explode(to).alias("chunk"))
    rows = rows.groupBy("recording", "channel", "n", "size", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    rows = rows.groupBy("recording", "n", "size", "chunk").agg(F.array_sort(F.collect_list(F.struct("channel", F.col("s.value").alias("x")))).alias("c"))
    rows = rows.select("recording", "n", "size", "chunk", F.col("c.channel").alias("channels"), F.flatten("c.x").alias("x"))

    def run(batches):
        from pyspark import TaskContext

        part, sums, heads, names = TaskContext.get().partitionId(), {}, {}, {}
        for b in batches:
            for i in range(b.num_rows):
                recording, n, long, chunk, channels = (b.column(k)[i].as_py() for k in range(5))
                x = np.asarray(b.column(5)[i].values, float).reshape(len(channels), -1)
                first = max(order, chunk * long) - max(0, chunk * long - order)  # where in x the chunk's own times begin
                z = np.concatenate([x[:, first - k : x.shape[1] - k] for k in range(order + 1)])
                sums[recording] = sums.get(recording, 0) + z @ z.T
                names[recording] = (channels, n)
                if chunk == 0:
                    heads[recording] = x[:, :order]
        for recording, g in sums.items():
            channels, n = names[recording]
            each = max(1, block_numbers // len(g))
            for k in range(0, len(g), each):
                head = heads[recording].ravel() if recording in heads and not k else np.zeros(len(channels) * order if not k else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([recording]), pa.array([channels]), pa.array([n]), pa.array([k], pa.int64()), pa.array([part], pa.int32()), lists([np.concatenate([head, g[k : k + each].ravel()])]).cast(pa.list_(pa.float64()))],
                    names=["recording", "channels", "n", "row", "part", "g"],
                )

    parts = rows.mapInArrow(run, "recording string, channels array<string>, n long, row long, part int, g array<double>")
    total = summed(parts, ["recording", "channels", "n", "row"], "g").groupBy("recording", "channels", "n").agg(F.array_sort(F.collect_list(F.struct("row", "g"))).alias("s"))
    flat = total.select("recording", "channels", "n", F.flatten("s.g").alias("flat"))
    heads = F.size("channels") * order
    return flat.select("recording", "channels", "n", F.slice("flat", heads + 1, F.size("flat") - heads).alias("g"), F.slice("flat", F.lit(1), heads).alias("head"))


def _network(samples: DataFrame, sr: float, order: int | None, freqs, band, measure) -> DataFrame:
    """Rows (recording, target, source, value, order): band means of a measure of all channels of a recording."""
    f = np.linspace(0, sr / 2, 128) if freqs is None else np.asarray(freqs, float)
    keep = np.ones(len(f), bool) if band is None else (f >= band[0]) & (f <= band[1])
    most = D.MOST_ORDER if order is None else order

    def kernel(recording, channels, n, g, head):
        c = len(channels)
        full, head = g.reshape(c * (most + 1), -1), head.reshape(c, most)

        def lower(p: int) -> tuple[np.ndarray, int]:
            """Sums for p lags: those of all lags cut down, and the times from p on that these leave out."""
            m = full[: c * (p + 1), : c * (p + 1)]
            if p < most:
                z = np.concatenate([head[:, p - k : most - k] for k in range(p + 1)])
                m = m + z @ z.T
            return m, n - p

        p = D.least_aic(lower, n, c) if order is None else order
        try:
            m = measure(*D.mvar_from_gram(*lower(p), c, p), f, sr)[keep].mean(0)
        except np.linalg.LinAlgError:
            m = np.full((c, c), np.nan)
        return [{"target": channels[i], "source": channels[j], "value": m[i, j], "order": p} for i in range(c) for j in range(c)]

    return map_rows(network_grams(samples, most), kernel, "target string, source string, value double, order int", ["recording"])


def directed_transfer_function(samples: DataFrame, sr: float, order: int | None = 5, freqs=None, normalized: bool = True, full_frequency: bool = False, band=None) -> DataFrame:
    """Rows (recording, target, source, value, order); NaN where the model is singular. A null order is chosen by AIC."""
    return _network(samples, sr, order, freqs, band, lambda a, s, f, r: D.dtf(D.transfer(a, f, r)[1], normalized, full_frequency))


def partial_directed_coherence(samples: DataFrame, sr: float, order: int | None = 5, freqs=None, generalized: bool = True, band=None) -> DataFrame:
    """Rows (recording, target, source, value, order)."""
    return _network(samples, sr, order, freqs, band, lambda a, s, f, r: D.pdc(D.transfer(a, f, r)[0], s, generalized))


def te_histogram(samples: DataFrame, bins: int = 8, delay: int = 1) -> DataFrame:
    """Rows (recording, channel_x, channel_y, te_xy, te_yx, net_te) in bits, histories of one sample, by counting.

    Bins are of equal width between each column's extremes, right-closed. Pairs
    meet on the sample index; counts then replace samples.
    """
    keys = ["recording", "channel"]
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = samples.withColumn("future", F.lead("value", delay).over(w)).where("future is not null")
    every = Window.partitionBy(*keys)

    def code(c: str):
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((F.col(c) - lo) / ((hi - lo) / bins)).cast("int") - 1))).otherwise(0)

    coded = rows.select(*keys, "idx", code("value").alias("now"), code("future").alias("next"))
    pairs = ordered_pairs(coded, ["now", "next"], ["recording", "idx"], both=True)  # x is the source
    n = pairs.groupBy(*PAIR, F.col("next_y").alias("a"), F.col("now_y").alias("b"), F.col("now_x").alias("c")).agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*PAIR, *c))
    terms = n.select(*PAIR, "n", (F.log2(F.col("n") * over("b") / (over("a", "b") * over("b", "c")))).alias("l"), over().alias("all"))
    te = terms.groupBy(*PAIR).agg((F.sum(F.col("n") * F.col("l")) / F.max("all")).alias("te"))
    back = te.select("recording", F.col("channel_x").alias("channel_y"), F.col("channel_y").alias("channel_x"), F.col("te").alias("te_yx"))
    out = te.withColumnRenamed("te", "te_xy").where("channel_x < channel_y").join(back, PAIR)
    return out.select(*PAIR, "te_xy", "te_yx", (F.col("te_xy") - F.col("te_yx")).alias("net_te"))


def transfer_entropy(samples: DataFrame, k: int = 1, l: int = 1, delay: int = 1, estimator: str = "ksg", knn: int = 4, bins: int = 8, effective: bool = False, n_surrogate: int = 19, seed: int = 0) -> DataFrame:  # noqa: E741
    """Rows (recording, channel_x, channel_y, te_xy, te_yx, net_te[, eff_te_xy, eff_te_yx, null_sd_xy, null_sd_yx]).

    By nearest neighbours, or by counts of one past sample, signals of any length
    are spread over tasks; other histories by counts, and `effective` (which draws
    surrogates of whole signals), take a row a pair.
    """
    if estimator not in ("ksg", "histogram"):
        raise ValueError(f"unknown estimator {estimator!r}")
    if estimator == "histogram" and k == l == 1 and not effective:
        return te_histogram(samples, bins, delay)
    if estimator == "ksg" and not effective:
        return neighbours.te_ksg(samples, k, l, delay, knn)
    names = ["te_xy", "te_yx", "net_te"] + (["eff_te_xy", "eff_te_yx", "null_sd_xy", "null_sd_yx"] if effective else [])

    def kernel(x_x, x_y, **_):
        return D.transfer_entropy(x_x, x_y, k, l, delay, estimator, knn, bins, effective, n_surrogate, seed)

    return map_rows(ordered_pairs(pack(samples), ["x"]), kernel, ", ".join(f"{n} double" for n in names), PAIR)
