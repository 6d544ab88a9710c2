"""Kernels as table functions of SQL: coherence and Granger causality of pairs of signals.

    SELECT * FROM coherence(24.0D, 64,
        TABLE(pairs) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)

The table has a row a sample: recording, channel_x, channel_y, idx, x, y. It comes
in Arrow batches in order of idx, and a function keeps sums and the samples that
later ones still need (one segment, or as many as the order), so a pair may be of
any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from resonarium.functions import directed as D
from resonarium.functions.filters import hann
from resonarium.session import ship

PAIR = ["recording", "channel_x", "channel_y"]


class _Pair:
    """Samples of a pair as they come, and whose they are."""

    def __init__(self):
        self.names, self.rest, self.n = None, np.zeros((2, 0)), 0

    def taken(self, batch: pa.RecordBatch) -> bool:
        if not batch.num_rows:
            return False
        if self.names is None:
            self.names = {c: batch.column(c)[0].as_py() for c in PAIR}
        new = np.stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in ("x", "y")])
        if not np.isfinite(new).all():
            raise ValueError("samples must be finite")
        self.rest, self.n = np.concatenate([self.rest, new], 1), self.n + batch.num_rows
        return True

    def told(self, rows: int, columns: dict) -> pa.Table:
        return pa.table({c: [v] * rows for c, v in self.names.items()} | columns)


@arrow_udtf(returnType="recording string, channel_x string, channel_y string, bin int, frequency double, coherence double, confidence double")
class Coherence(_Pair):
    """coherence(sr, nperseg, TABLE): magnitude-squared coherence by Hann segments that overlap by half.

    A pair shorter than a segment is one segment of its own length; coherence is
    null where a channel has no power.
    """

    def __init__(self):
        super().__init__()
        self.sums, self.segments = None, 0

    def _add(self, part: np.ndarray) -> None:
        f = np.fft.rfft(part * hann(part.shape[1]))
        new = np.stack([np.abs(f[0]) ** 2, np.abs(f[1]) ** 2, f[0] * f[1].conj()])
        self.sums, self.segments = new if self.sums is None else self.sums + new, self.segments + 1

    def eval(self, sr: pa.Array, nperseg: pa.Array, batch: pa.RecordBatch):
        self.sr, self.size = sr[0].as_py(), nperseg[0].as_py()
        if self.size < 2:
            raise ValueError("a segment needs two samples")
        if self.taken(batch):
            step = self.size - self.size // 2
            while self.rest.shape[1] >= self.size:
                self._add(self.rest[:, : self.size])
                self.rest = self.rest[:, step:]
        return iter(())

    def terminate(self):
        if self.names is not None:
            if not self.segments:
                self.size = self.n
                self._add(self.rest)
            xx, yy, xy = self.sums
            power = xx.real * yy.real
            value = np.where(power > 0, np.clip(np.abs(xy) ** 2 / np.where(power > 0, power, 1), 0, 1), np.nan)
            bins, last = len(value), self.size // 2
            limit = 1.0 if self.segments <= 1 else 1 - 0.05 ** (1 / (self.segments - 1))
            frequency = np.arange(bins) * (self.sr / 2) / last if last else np.zeros(bins)
            yield self.told(bins, {"bin": pa.array(np.arange(bins), pa.int32()), "frequency": frequency, "coherence": pa.array(value, pa.float64(), from_pandas=True), "confidence": [limit] * bins})


@arrow_udtf(returnType="recording string, channel_x string, channel_y string, gc_xy double, gc_yx double, net_gc double, status string")
class Granger(_Pair):
    """granger(order, TABLE): causality both ways from lagged sums of products, about the means."""

    def __init__(self):
        super().__init__()
        self.gram = self.sums = self.whole = None
        self.rows = 0

    def eval(self, order: pa.Array, batch: pa.RecordBatch):
        self.order = order[0].as_py()
        if self.order < 1:
            raise ValueError("the order must be positive")
        before = self.rest.shape[1]
        if self.taken(batch):
            new = self.rest[:, before:].sum(1)
            self.whole = new if self.whole is None else self.whole + new
            p, m = self.order, self.rest.shape[1]
            if m > p:
                z = np.concatenate([np.stack([c[p - k : m - k] for k in range(p + 1)]) for c in self.rest])
                if self.gram is None:
                    self.first = z[:, :1].copy()  # sums are taken about these values, which keeps them small
                    self.gram, self.sums = np.zeros((len(z),) * 2), np.zeros(len(z))
                z = z - self.first
                self.gram, self.sums, self.rows = self.gram + z @ z.T, self.sums + z.sum(1), self.rows + z.shape[1]
                self.rest = self.rest[:, m - p :]
        return iter(())

    def terminate(self):
        if self.names is None:
            return
        p = self.order
        if self.rows <= p + 1:
            none = pa.array([None], pa.float64())
            yield self.told(1, {"gc_xy": none, "gc_yx": none, "net_gc": none, "status": ["the signals are too short for this order"]})
            return
        off = np.repeat(self.whole / self.n, p + 1) - self.first[:, 0]
        g = self.gram - np.outer(off, self.sums) - np.outer(self.sums, off) + self.rows * np.outer(off, off)
        x, y = list(range(p + 1)), list(range(p + 1, 2 * p + 2))
        one = lambda target, driver: D.granger_from_gram(g[np.ix_(target + driver[1:], target + driver[1:])], self.rows, p)
        a, b = one(y, x), one(x, y)
        yield self.told(1, {"gc_xy": [a], "gc_yx": [b], "net_gc": [a - b], "status": ["ok"]})


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    ship(spark)
    spark.udtf.register("coherence", Coherence)
    spark.udtf.register("granger", Granger)


#: Pairs of the channels of a table of samples (recording, channel, idx, value), which is to be put in.
PAIRS = """SELECT x.recording, x.channel AS channel_x, y.channel AS channel_y, x.idx, x.value AS x, y.value AS y
FROM {samples} x JOIN {samples} y ON x.recording = y.recording AND x.idx = y.idx AND x.channel < y.channel"""
