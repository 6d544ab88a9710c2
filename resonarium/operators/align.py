"""Common rates, merging of recordings, and elastic warping over SignalSets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonarium.functions import elastic, filters
from resonarium.model import CHANNELS, SAMPLES, SignalSet
from resonarium.operators.packed import map_rows, pack, unpack


def lerp_table(lengths: DataFrame, n_new: Column, keys: list[str]) -> DataFrame:
    """For each new index its left neighbour and weight; lengths: keys + n. Both grids share their ends."""
    rows = lengths.withColumn("m", n_new).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    u = F.col("j") * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1))
    left = F.least(F.floor(u), F.greatest(F.col("n") - 2, F.lit(0)))
    return rows.select(*keys, "j", left.cast("long").alias("k"), (u - left).alias("w"))


def resample_linear(samples: DataFrame, n_new: Column, keys: list[str]) -> DataFrame:
    """Linear resampling by equi-joins on the two neighbours' indices; n_new may use the column n (old length)."""
    lengths = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("n"))
    at = lerp_table(lengths, n_new, keys)
    # each new point asks for two old ones; one join and one sum instead of two joins
    asked = at.select(*keys, "j", F.explode(F.array(F.struct(F.col("k").alias("idx"), (1 - F.col("w")).alias("c")), F.struct((F.col("k") + 1).alias("idx"), F.col("w").alias("c")))).alias("a"))
    asked = asked.select(*keys, "j", "a.idx", "a.c").where("c != 0")
    return asked.join(samples, [*keys, "idx"]).groupBy(*keys, F.col("j").alias("idx")).agg(F.sum(F.col("c") * F.col("value")).alias("value"))


def align_to_rate(s: SignalSet, target: float, method: str = "linear", kind: str = "butter") -> SignalSet:
    """All channels at `target` Hz. Channels that are thinned are low-passed first."""
    if target <= 0:
        raise ValueError("a positive rate is needed")
    rates = s.channels.select("modality", "channel", "sr")
    packed = pack(s.samples, ["modality", "channel"]).join(rates, ["modality", "channel"])
    moved = map_rows(packed, lambda modality, channel, x, sr: {"x": filters.to_rate(x, sr, target, method, kind)}, "x array<double>", ["modality", "channel"])
    return SignalSet(unpack(moved).select(*SAMPLES[:2], F.col("idx").cast("long").alias("idx"), "value"), s.channels.withColumn("sr", F.lit(float(target))))


def align(s: SignalSet, method: str = "lowest_rate", target: float | None = None, resampling: str = "linear", kind: str = "butter") -> SignalSet:
    """One rate for all modalities: the lowest, the highest (common_rate), a given one (resample), or the lowest with warping (elastic)."""
    if method not in ("lowest_rate", "common_rate", "resample", "elastic"):
        raise ValueError(f"unknown method {method!r}")
    if method == "resample":
        if target is None:
            raise ValueError("resample needs a target rate")
    else:
        target = s.channels.agg((F.max if method == "common_rate" else F.min)("sr")).first()[0]
    out = align_to_rate(s, target, resampling, kind)
    return warp_to_first(out) if method == "elastic" else out


def warp_to_first(s: SignalSet) -> SignalSet:
    """Each further modality warped so that its first channel follows the first modality's; those of another length stay."""
    packed = pack(s.samples, ["modality", "channel"])
    heads = packed.groupBy("modality").agg(F.min_by("x", "channel").alias("x"))
    first = heads.agg(F.min_by("x", "modality").alias("ref"), F.min("modality").alias("m"))
    both = heads.crossJoin(F.broadcast(first)).where((F.col("modality") != F.col("m")) & (F.size("x") == F.size("ref"))).select("modality", "x", "ref")
    warps = map_rows(both, lambda modality, x, ref: {"gamma": elastic.align(ref, x)["gamma"]}, "gamma array<double>", ["modality"])
    moved = map_rows(packed.join(warps, "modality", "left"), lambda modality, channel, x, gamma: {"x": x if gamma is None else elastic.warp(x, gamma)}, "x array<double>", ["modality", "channel"])
    return SignalSet(unpack(moved).select("modality", "channel", F.col("idx").cast("long").alias("idx"), "value"), s.channels)


def elastic_align(curves: DataFrame, max_step: int = 6) -> DataFrame:
    """Rows (.., x, y) with gamma, aligned, amplitude and phase distance of y warped onto x."""
    keep = [c for c in curves.columns if c not in ("x", "y")]

    def kernel(x, y, **_):
        got = elastic.align(x, y, max_step=max_step)
        return {k: got[k] for k in ("gamma", "aligned", "amplitude_distance", "phase_distance")}

    return map_rows(curves, kernel, "gamma array<double>, aligned array<double>, amplitude_distance double, phase_distance double", keep)


def srvf_mean(curves: DataFrame, rounds: int = 5, max_step: int = 6) -> tuple[np.ndarray, DataFrame]:
    """The mean of curves (curve, y) under alignment: each round warps all to the mean and averages. The mean is one curve, so it travels in the closure."""
    mean = lambda df, c: np.array([r["v"] for r in df.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()])
    mu, aligned = mean(curves, "y"), curves
    for _ in range(rounds):
        aligned = map_rows(curves.select("curve", "y"), lambda curve, y, mu=mu: {k: v for k, v in elastic.align(mu, y, max_step=max_step).items() if k in ("gamma", "aligned")}, "gamma array<double>, aligned array<double>", ["curve"])
        mu = mean(aligned, "aligned")
    return mu, aligned


def merge(a: DataFrame, b: DataFrame, prefix: tuple[str, str] = ("x_", "y_")) -> DataFrame:
    """Channels of two recordings side by side: samples (channel, idx, value) with prefixed labels."""
    return a.withColumn("channel", F.concat(F.lit(prefix[0]), "channel")).unionByName(b.withColumn("channel", F.concat(F.lit(prefix[1]), "channel")), allowMissingColumns=True)


def merge_sets(a: SignalSet, b: SignalSet, name: str = "merged", prefix: tuple[str, str] = ("x_", "y_")) -> SignalSet:
    """Two single-modality sets of equal rate and length as one modality; metadata columns are united."""
    stats = []
    for s in (a, b):
        sr = s.channels.agg(F.min("sr"), F.max("sr")).first()
        n = s.samples.agg(F.max("idx")).first()[0]
        if sr[0] != sr[1]:
            raise ValueError("a recording has several rates")
        stats.append((sr[0], n))
    if abs(stats[0][0] - stats[1][0]) > 1e-6:
        raise ValueError("the rates differ; align them first")
    if stats[0][1] != stats[1][1]:
        raise ValueError("the lengths differ")
    label = lambda s, p: s.channels.withColumns({"label": F.concat(F.lit(p), F.coalesce("label", "channel")), "channel": F.concat(F.lit(p), "channel")}).withColumn("modality", F.lit(name))
    channels = label(a, prefix[0]).unionByName(label(b, prefix[1]), allowMissingColumns=True)
    samples = merge(a.samples.withColumn("modality", F.lit(name)), b.samples.withColumn("modality", F.lit(name)), prefix)
    return SignalSet(samples.select(*SAMPLES), channels.select(*CHANNELS, *(c for c in channels.columns if c not in CHANNELS)))


def srvf_rows(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Square-root velocities by lead(); the last repeats the one before. The grid is [0, 1]."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("idx")
    n = F.max("idx").over(Window.partitionBy(*keys))
    d = (F.lead("value").over(w) - F.col("value")) * n
    rows = samples.withColumn("_d", d)
    d = F.coalesce("_d", F.lag("_d").over(w))
    return rows.withColumn("q", F.signum(d) * F.sqrt(F.abs(d))).drop("_d")
