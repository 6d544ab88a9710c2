"""Cross-correlation of channel pairs, over whole signals and over sliding windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.operators.directed import summed
from resonarium.operators.packed import lists, map_rows, ordered_pairs, pack
from resonarium.session import ship

PAIR = ["recording", "channel_x", "channel_y"]
#: Samples in a chunk, and signals up to which their means are broadcast.
CHUNK, BROADCAST_SIGNALS = 65_536, 100_000


def ccf(x: np.ndarray, y: np.ndarray, max_lag: int, normalize: bool = True) -> np.ndarray:
    """c(h) = sum (x[t+h] - mean)(y[t] - mean) / n for h = -max_lag .. max_lag, by FFT."""
    n = min(len(x), len(y))
    a, b = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
    size = 1 << int(np.ceil(np.log2(2 * n)))
    c = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size).conj(), size) / n
    c = np.concatenate([c[-max_lag:], c[: max_lag + 1]]) if max_lag else c[:1]
    if normalize:
        den = np.sqrt((a**2).mean() * (b**2).mean())
        c = c / den if den > 0 else np.full(len(c), np.nan)
    return c


def lagged_sums(samples: DataFrame, max_lag: int, chunk: int = CHUNK, signals: int | None = None) -> DataFrame:
    """Rows (recording, channel_x, channel_y, n, v): sums of products about the means at all lags, then both channels' sums of squares.

    The channels of a recording must be of one length n. Time is cut into chunks
    with max_lag samples on both sides, all channels of a chunk are one row, and
    each is transformed twice however many pairs it is in; a task adds up its
    chunks before pairs are added up. signals: how many there are, if known.
    """
    ship(samples.sparkSession)
    value = F.col("value").cast("double")
    mean = F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.avg(value))  # a constant signal is 0 about its mean, not nearly so
    about = samples.groupBy("recording", "channel").agg((F.max("idx") + 1).alias("n"), mean.alias("mean"))
    about = F.broadcast(about) if (about.count() if signals is None else signals) <= BROADCAST_SIGNALS else about
    rows = samples.join(about, ["recording", "channel"]).select("recording", "channel", "n", "idx", (value - F.col("mean")).alias("value"))
    lags = F.least(F.lit(max_lag), F.col("n") - 1)
    to = F.sequence(F.greatest(F.lit(0), F.floor((F.col("idx") - lags) / chunk)), F.least(F.floor((F.col("n") - 1) / chunk), F.floor((F.col("idx") + lags) / chunk)))
    rows = rows.withColumn("chunk", F.explode(to)).groupBy("recording", "channel", "n", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    rows = rows.groupBy("recording", "n", "chunk").agg(F.array_sort(F.collect_list(F.struct("channel", F.col("s.value").alias("x")))).alias("c")).where(F.size("c") > 1)
    rows = rows.select("recording", "n", "chunk", F.col("c.channel").alias("channels"), F.flatten("c.x").alias("x"))

    def run(batches):
        from pyspark import TaskContext

        sums: dict = {}
        for b in batches:
            for r in range(b.num_rows):
                recording, n, at, channels = (b.column(k)[r].as_py() for k in range(4))
                x, m = np.asarray(b.column(4)[r].values, float).reshape(len(channels), -1), min(max_lag, n - 1)
                first, last = at * chunk, min(n, (at + 1) * chunk)
                begin = max(0, first - m)
                wide = np.zeros((len(channels), last - first + 2 * m))
                wide[:, begin - (first - m) :][:, : x.shape[1]] = x
                own = x[:, first - begin : last - begin]
                points = 1 << int(np.ceil(np.log2(max(2, wide.shape[1] + own.shape[1]))))
                a, c, e = np.fft.rfft(wide, points), np.fft.rfft(own, points).conj(), (own**2).sum(1)
                for i in range(len(channels)):
                    for j in range(i + 1, len(channels)):
                        v = np.concatenate([np.fft.irfft(a[i] * c[j], points)[: 2 * m + 1], [e[i], e[j]]])
                        key = (recording, channels[i], channels[j], n)
                        sums[key] = sums[key] + v if key in sums else v
        if sums:
            part, keys = TaskContext.get().partitionId(), list(sums)
            named = [pa.array([k[c] for k in keys]) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*named, pa.array([k[3] for k in keys], pa.int64()), pa.array([part] * len(keys), pa.int32()), lists(sums.values())], names=[*PAIR, "n", "part", "v"])

    return summed(rows.mapInArrow(run, "recording string, channel_x string, channel_y string, n long, part int, v array<double>"), [*PAIR, "n"], "v")


def cross_correlation(samples: DataFrame, sr: float, max_lag: int | None = None, normalize: bool = True) -> DataFrame:
    """Rows (recording, channel_x, channel_y, lag, lag_sec, correlation); a peak at a negative lag means that x leads.

    With max_lag given and channels of one length in each recording, signals are
    cut into chunks (lagged_sums); else a pair is a row, as the default of a
    quarter of the signal leaves little to cut.
    """
    if max_lag is not None:
        sizes = samples.groupBy("recording", "channel").agg(F.max("idx").alias("n")).groupBy("recording").agg((F.min("n") != F.max("n")).alias("differ"), F.count("*").alias("signals"))
        known = sizes.agg(F.coalesce(F.bool_or("differ"), F.lit(False)).alias("differ"), F.coalesce(F.sum("signals"), F.lit(0)).alias("signals")).first()
        if not known["differ"]:
            m = F.least(F.lit(max_lag), F.col("n") - 1).cast("int")
            rows = lagged_sums(samples, max_lag, signals=known["signals"]).withColumn("m", m)
            power = F.sqrt(F.get("v", 2 * F.col("m") + 1) * F.get("v", 2 * F.col("m") + 2))
            rows = rows.withColumn("den", power if normalize else F.col("n").cast("double"))
            rows = rows.select(*PAIR, "m", "den", F.posexplode(F.slice("v", F.lit(1), 2 * F.col("m") + 1)).alias("k", "s"))
            value = F.when(F.col("den") > 0, F.col("s") / F.col("den")).otherwise(F.lit(float("nan")))
            return rows.select(*PAIR, (F.col("k") - F.col("m")).alias("lag"), ((F.col("k") - F.col("m")) / sr).alias("lag_sec"), value.alias("correlation"))

    def kernel(x_x, x_y, **_):
        n = min(len(x_x), len(x_y))
        m = n // 4 if max_lag is None else min(max_lag, n - 1)
        return {"lags": np.arange(-m, m + 1), "values": ccf(x_x, x_y, m, normalize)}

    rows = map_rows(ordered_pairs(pack(samples), ["x"]), kernel, "lags array<int>, values array<double>", PAIR)
    rows = rows.select(*PAIR, F.explode(F.arrays_zip("lags", "values")).alias("z"))
    return rows.select(*PAIR, F.col("z.lags").alias("lag"), (F.col("z.lags") / sr).alias("lag_sec"), F.col("z.values").alias("correlation"))


def correlation_peak(rows: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Rows (keys, peak_lag, peak_lag_sec, peak): the first lag of largest absolute correlation."""
    best = F.struct(F.abs("correlation").alias("v"), (-F.col("lag")).alias("l"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("lag", "lag_sec", "correlation"), best).alias("p")).select(*keys, F.col("p.lag").alias("peak_lag"), F.col("p.lag_sec").alias("peak_lag_sec"), F.col("p.correlation").alias("peak"))


def windows_of(samples: DataFrame, size: int, step: int) -> DataFrame:
    """Rows (recording, channel, win, start, x): complete windows, packed. Each sample goes to the windows that own it."""
    idx = F.col("idx")
    first = F.greatest(F.lit(0), F.ceil((idx - size + 1) / step)).cast("long")
    owned = samples.withColumn("win", F.explode(F.sequence(first, F.floor(idx / step).cast("long"))))
    packed = pack(owned, ["recording", "channel", "win"]).where(F.size("x") == size)
    return packed.withColumn("start", F.col("win") * step)


def sliding_cross_correlation(samples: DataFrame, sr: float, window_sec: float = 1, step_sec: float = 0.5, max_lag: int | None = None) -> DataFrame:
    """Rows (recording, channel_x, channel_y, win, time, lag, correlation); time is the window's centre."""
    size, step = max(2, int(round(window_sec * sr))), max(1, int(round(step_sec * sr)))
    m = size // 4 if max_lag is None else min(max_lag, size - 1)

    def kernel(x_x, x_y, **_):
        return {"values": ccf(x_x, x_y, m)}

    pairs = ordered_pairs(windows_of(samples, size, step), ["x"], ["recording", "win"])
    rows = map_rows(pairs, kernel, "values array<double>", [*PAIR, "win"])
    rows = rows.select(*PAIR, "win", F.posexplode("values").alias("k", "correlation"))
    time = (F.col("win") * step + (size - 1) / 2) / sr
    return rows.select(*PAIR, "win", time.alias("time"), (F.col("k") - m).alias("lag"), ((F.col("k") - m) / sr).alias("lag_sec"), "correlation")


def lag1(samples: DataFrame) -> DataFrame:
    """Rows (recording, channel, acf1): lag-one autocorrelation within [0, 0.999], 0 where undefined."""
    from pyspark.sql import Window

    keys = ["recording", "channel"]
    d = samples.withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    d = d.withColumn("p", F.lag("d").over(Window.partitionBy(*keys).orderBy("idx")))
    sums = d.groupBy(*keys).agg(F.sum(F.col("d") * F.col("p")).alias("a"), F.sum(F.col("d") ** 2).alias("b"))
    return sums.select(*keys, F.when(F.col("b") > 0, F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("a") / F.col("b")))).otherwise(0.0).alias("acf1"))
