"""Recursive filters over signals of any length: chunks filtered apart, their states put together by a prefix.

A filter over a chunk is an affine map of its state. Each chunk is filtered from
rest once, which gives its outputs and the map's constant; the maps are composed
by a prefix over groups of GROUP chunks, groups of groups and so on; and what the
state at its start adds to a chunk follows from that state alone. The samples are
shuffled once, into chunks; forward and backward pass then go chunk by chunk, and
only states of a few numbers are exchanged.

The way back begins `pad` zeros beyond the end, which is one fixed map of the
state there, so no chunk is longer for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.functions import filters, recursive
from resonarium.operators.packed import map_groups
from resonarium.session import Scratch

SIGNAL = ["recording", "channel"]
#: Samples in a chunk, and chunks whose states one row puts together.
CHUNK, GROUP = 65_536, 1024


def chunked(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (recording, channel, chunk, x): `chunk` values each in order, the last ones fewer."""
    pair = F.struct(F.col("idx").alias("i"), F.col("value").cast("double").alias("v"))
    rows = samples.groupBy(*SIGNAL, F.floor(F.col("idx") / chunk).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(pair)).alias("s"))
    return rows.select(*SIGNAL, "chunk", F.col("s.v").alias("x"))


def unchunked(chunks: DataFrame, chunk: int, name: str = "x") -> DataFrame:
    rows = chunks.select(*SIGNAL, "chunk", F.posexplode(name).alias("i", "value"))
    return rows.select(*SIGNAL, (F.col("chunk") * chunk + F.col("i")).alias("idx"), "value")


def states(maps: DataFrame, system: recursive.System, begin: DataFrame | None, scratch: Scratch, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The state before each map and after the last one.

    maps: rows (recording, channel, at, n, b), applied in order of `at`; a map
    takes s to A**n s + b. begin: rows (recording, channel, s), rest where None.
    Gives rows (.., at, s) and rows (.., s). Groups of maps are composed apart,
    and so are groups of groups until a signal is one.
    """
    own = (F.col("at") / group).cast("long").alias("above")  # towards 0: the way back counts down from it
    rows = maps.groupBy(*SIGNAL, own).agg(F.array_sort(F.collect_list(F.struct("at", "n", "b"))).alias("m"))
    rows = scratch.save(rows.select(*SIGNAL, "above", F.col("m.at").alias("ats"), F.col("m.n").alias("ns"), F.flatten("m.b").alias("bs")))

    def compose(above, ns, bs, **_):
        s = np.zeros(system.size)
        for n, b in zip(ns.astype(int).tolist(), bs.reshape(-1, system.size)):
            s = system.power(n) @ s + b
        return [{"at": above, "n": int(ns.sum()), "b": s}]

    whole = scratch.save(map_groups(rows, compose, "at long, n long, b array<double>", SIGNAL, ["b"]))
    if whole.groupBy(*SIGNAL).count().where("count > 1").limit(1).count():
        before, after = states(whole, system, begin, scratch, group)
    else:
        rest = F.array(*[F.lit(0.0)] * system.size)
        joined = whole.join(begin, SIGNAL, "left") if begin is not None else whole.withColumn("s", F.lit(None).cast("array<double>"))
        joined = joined.withColumn("s", F.coalesce("s", rest))
        before = joined.select(*SIGNAL, "at", "s")
        after = map_groups(joined, lambda n, b, s, **_: [{"e": system.power(n) @ s + b}], "e array<double>", SIGNAL, ["e"]).withColumnRenamed("e", "s")

    def each(ats, ns, bs, s, **_):
        out = []
        for at, n, b in zip(ats.astype(int).tolist(), ns.astype(int).tolist(), bs.reshape(-1, system.size)):
            out.append({"at": at, "e": s})
            s = system.power(n) @ s + b
        return out

    inner = rows.join(before.withColumnRenamed("at", "above"), [*SIGNAL, "above"])
    return map_groups(inner, each, "at long, e array<double>", SIGNAL, ["e"]).withColumnRenamed("e", "s"), after


def one_way(chunks: DataFrame, system: recursive.System, begin: DataFrame | None, scratch: Scratch, back: bool, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Filtered chunks and each signal's last state; chunks: a saved table."""
    step = -1 if back else 1

    def from_rest(chunk, x, **_):
        y, s = system.run(x[::step])
        return [{"at": chunk * step, "n": len(x), "b": s, "y": y[::step]}]

    apart = scratch.save(map_groups(chunks, from_rest, "at long, n long, b array<double>, y array<double>", [*SIGNAL, "chunk"], ["b", "y"]))
    before, after = states(apart.select(*SIGNAL, "at", "n", "b"), system, begin, scratch, group)

    def onward(y, s, **_):
        return [{"x": y + system.fading(s, len(y))[::step]}]

    met = apart.select(*SIGNAL, "chunk", "at", "y").join(before, [*SIGNAL, "at"])
    return map_groups(met, onward, "x array<double>", [*SIGNAL, "chunk"], ["x"]), after


def zero_phase(samples: DataFrame, sections: np.ndarray, pad: int, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Rows (recording, channel, idx, value): forward from rest and backward from rest, `pad` zeros in between.

    Samples are those from idx 0 without gaps; null values are an error of the source.
    """
    scratch, system = Scratch(samples.sparkSession, "recursive"), recursive.System(sections)
    chunks = scratch.save(chunked(samples, chunk))
    forth, end = one_way(chunks, system, None, scratch, False, group)
    turn = system.turning(pad)
    begin = scratch.save(map_groups(end, lambda s, **_: [{"t": turn @ s}], "t array<double>", SIGNAL, ["t"]).withColumnRenamed("t", "s"))
    back, _ = one_way(scratch.save(forth), system, begin, scratch, True, group)
    return unchunked(back, chunk)


def bandpass(samples: DataFrame, sr: float, band: tuple[float, float], order: int = 4, clamp: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase Butterworth band-pass of signals of any length; equal to functions.filters.bandpass of the kind recursive."""
    filters.check_band(band[0], band[1], sr)
    lo, hi = filters.relative(band[0], band[1], sr, clamp)
    return zero_phase(samples, recursive.butterworth(order, lo, hi), recursive.padding(order, True), chunk)


def lowpass(samples: DataFrame, sr: float, cutoff: float, order: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase Butterworth low-pass; a cutoff at or above half the rate changes nothing."""
    if cutoff >= sr / 2:
        return samples.select(*SIGNAL, "idx", F.col("value").cast("double").alias("value"))
    _, hi = filters.relative(None, cutoff, sr, True)
    return zero_phase(samples, recursive.butterworth(order, None, hi), recursive.padding(order, False), chunk)
