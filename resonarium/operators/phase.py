"""Phase and amplitude coupling: one band-passed analytic signal a channel, then sums over samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions import filters
from resonarium.operators.packed import correlation, map_rows, pack
from resonarium.session import Scratch

PAIR = ["recording", "channel_x", "channel_y"]
EPS = float(np.finfo(float).eps)


def analytic(samples: DataFrame, sr: float, band: tuple[float, float], order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (recording, channel, idx, re, im)."""
    filters.check_band(band[0], band[1], sr)

    def kernel(recording, channel, x):
        z = filters.band_analytic(x, band[0], band[1], sr, order, kind)
        return {"re": z.real, "im": z.imag}

    rows = map_rows(pack(samples), kernel, "re array<double>, im array<double>", ["recording", "channel"])
    return rows.select("recording", "channel", F.posexplode(F.arrays_zip("re", "im")).alias("idx", "z")).select("recording", "channel", "idx", "z.re", "z.im")


def sample_pairs(z: DataFrame) -> DataFrame:
    """Rows (recording, channel_x, channel_y, idx, ax, bx, ay, by): all pairs of channels, sample by sample.

    The channels of one sample meet in one group (as many as there are
    channels), and pairs are made inside it, so samples move once however many
    pairs there are.
    """
    met = z.groupBy("recording", "idx").agg(F.array_sort(F.collect_list(F.struct("channel", "re", "im"))).alias("c"))
    left = met.select("recording", "idx", "c", F.posexplode("c").alias("i", "x"))
    both = left.select("recording", "idx", "x", F.explode(F.slice("c", F.col("i") + 2, F.greatest(F.lit(0), F.size("c") - F.col("i") - 1))).alias("y"))
    return both.select("recording", F.col("x.channel").alias("channel_x"), F.col("y.channel").alias("channel_y"), "idx", F.col("x.re").alias("ax"), F.col("x.im").alias("bx"), F.col("y.re").alias("ay"), F.col("y.im").alias("by"))


def _cross() -> tuple[Column, Column]:
    """Real and imaginary part of x times conjugate y."""
    return F.col("ax") * F.col("ay") + F.col("bx") * F.col("by"), F.col("bx") * F.col("ay") - F.col("ax") * F.col("by")


def _unit() -> tuple[Column, Column]:
    """Cosine and sine of the difference of phases; the phase of a zero is 0."""
    sx, sy = F.hypot("ax", "bx"), F.hypot("ay", "by")
    (cx, dx), (cy, dy) = ((F.when(s > 0, F.col(a) / s).otherwise(1.0), F.when(s > 0, F.col(b) / s).otherwise(0.0)) for s, a, b in ((sx, "ax", "bx"), (sy, "ay", "by")))
    return cx * cy + dx * dy, dx * cy - cx * dy


def synchrony(samples: DataFrame, sr: float, band: tuple[float, float], order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (recording, channel_x, channel_y, n, plv, pli, wpli, wpli_debiased, ciplv, ppc, aec): all in one pass over the pairs."""
    rows = sample_pairs(analytic(samples, sr, band, order, kind))
    c, s = _unit()
    _, im = _cross()
    px, py = F.col("ax") ** 2 + F.col("bx") ** 2, F.col("ay") ** 2 + F.col("by") ** 2
    re, im = _cross()
    # what of y does not follow x at once, and the other way round
    rest = lambda u, v, p, q: F.hypot(u - re * p / (F.pow(p, 2) + F.pow(q, 2) + EPS), v - re * q / (F.pow(p, 2) + F.pow(q, 2) + EPS))
    y_free, x_free = rest(F.col("ay"), F.col("by"), F.col("ax"), F.col("bx")), rest(F.col("ax"), F.col("bx"), F.col("ay"), F.col("by"))
    rows = rows.select(*PAIR, c.alias("c"), s.alias("s"), im.alias("im"), F.sqrt(px).alias("ex"), F.sqrt(py).alias("ey"), x_free.alias("fx"), y_free.alias("fy"))
    rows = rows.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("s").alias("ms"), F.avg(F.signum("s")).alias("sg"),
        F.sum("im").alias("si"), F.sum(F.abs("im")).alias("sa"), F.sum(F.col("im") ** 2).alias("sq"),
        F.coalesce(correlation("ex", "fy"), F.lit(0.0)).alias("r1"), F.coalesce(correlation("ey", "fx"), F.lit(0.0)).alias("r2"),
    )
    n = F.col("n")
    den = F.pow(F.col("sa"), 2) - F.col("sq")
    free = 1 - F.pow("mc", 2)
    return rows.select(
        *PAIR, "n", F.hypot("mc", "ms").alias("plv"), F.abs("sg").alias("pli"),
        F.when(F.col("sa") > 0, F.abs("si") / F.col("sa")).alias("wpli"), F.when(den > 0, (F.pow("si", 2) - F.col("sq")) / den).alias("wpli_debiased"),
        F.when(free > 0, F.abs(F.col("ms") / F.sqrt(free))).otherwise(0.0).alias("ciplv"),
        F.try_divide((F.pow(F.col("mc") * n, 2) + F.pow(F.col("ms") * n, 2)) - n, n * (n - 1)).alias("ppc"),
        ((F.when(F.isnan("r1"), 0.0).otherwise(F.col("r1")) + F.when(F.isnan("r2"), 0.0).otherwise(F.col("r2"))) / 2).alias("aec"),
    )


def phase_difference(samples: DataFrame, sr: float, band: tuple[float, float], wrapped: bool = True, order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (recording, channel_x, channel_y, idx, difference) of phases, wrapped to (-pi, pi] or as subtracted."""
    rows = sample_pairs(analytic(samples, sr, band, order, kind))
    re, im = _cross()
    value = F.atan2(im, re) if wrapped else F.atan2("bx", "ax") - F.atan2("by", "ay")
    return rows.select(*PAIR, "idx", value.alias("difference"))


def _one(name: str):
    def statistic(samples: DataFrame, sr: float, band: tuple[float, float], order: int = 4, kind: str = "butter") -> DataFrame:
        return synchrony(samples, sr, band, order, kind).select(*PAIR, "n", name)

    statistic.__name__ = name
    return statistic


phase_locking_value, phase_lag_index, ci_plv = _one("plv"), _one("pli"), _one("ciplv")
pairwise_phase_consistency, orthogonalized_aec = _one("ppc"), _one("aec")


def weighted_pli(samples: DataFrame, sr: float, band: tuple[float, float], debiased: bool = True, **how) -> DataFrame:
    """Null where all imaginary parts are zero."""
    name = "wpli_debiased" if debiased else "wpli"
    return synchrony(samples, sr, band, **how).select(*PAIR, "n", F.col(name).alias("wpli"))


def leida_vectors(samples: DataFrame, sr: float, band: tuple[float, float], order: int = 4, kind: str = "butter") -> DataFrame:
    """Rows (recording, idx, channel, v): the leading eigenvector of the phase-coherence matrix at each sample.

    That matrix is c c' + s s' for cosines c and sines s of the phases, so its
    leading eigenvector is c cos t + s sin t with tan 2t = 2 c's / (c'c - s's).
    The sign leaves at least as many positive parts as negative ones.
    """
    z = analytic(samples, sr, band, order, kind)
    size = F.hypot("re", "im")
    unit = z.select("recording", "channel", "idx", F.when(size > 0, F.col("re") / size).otherwise(1.0).alias("c"), F.when(size > 0, F.col("im") / size).otherwise(0.0).alias("s"))
    w = Window.partitionBy("recording", "idx")
    t = 0.5 * F.atan2(2 * F.sum(F.col("c") * F.col("s")).over(w), F.sum(F.col("c") ** 2 - F.col("s") ** 2).over(w))
    rows = unit.withColumn("t", t).withColumn("u", F.col("c") * F.cos("t") + F.col("s") * F.sin("t"))
    rows = rows.withColumn("u", F.coalesce(F.try_divide("u", F.sqrt(F.sum(F.col("u") ** 2).over(w))), F.lit(0.0)))
    flip = F.sum(F.when(F.col("u") > 0, 1).when(F.col("u") < 0, -1).otherwise(0)).over(w) < 0
    return rows.select("recording", "idx", "channel", F.when(flip, -F.col("u")).otherwise(F.col("u")).alias("v"))


def leida_states(samples: DataFrame, sr: float, band: tuple[float, float], n_states: int = 4, seed: int = 0, order: int = 4, kind: str = "butter", nstart: int = 10) -> DataFrame:
    """Rows (recording, idx, state) by k-means over all samples; states are numbered by their centres, first part first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = leida_vectors(samples, sr, band, order, kind)
    rows = v.groupBy("recording", "idx").agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("c")).select("recording", "idx", F.col("c.v").alias("v"))
    rows = Scratch(samples.sparkSession, "states").save(rows)  # every fit reads them, none makes them again
    rows = rows.select("recording", "idx", array_to_vector("v").alias("features"))
    best = min((KMeans(k=n_states, seed=seed + r, initMode="random", featuresCol="features", predictionCol="cluster").fit(rows) for r in range(nstart)), key=lambda m: m.summary.trainingCost)
    order_of = sorted(range(len(best.clusterCenters())), key=lambda k: tuple(best.clusterCenters()[k]))
    place = F.element_at(F.array(*(F.lit(order_of.index(k) + 1) for k in range(len(order_of)))), F.col("cluster") + 1)
    return best.transform(rows).select("recording", "idx", place.alias("state"))


def leida_transitions(states: DataFrame, keys: list[str] = ("recording",)) -> DataFrame:
    """Rows (keys, state_from, state_to, n, p): counted changes from one sample to the next, by row."""
    w = Window.partitionBy(*keys).orderBy("idx")
    pairs = states.withColumn("state_to", F.lead("state").over(w)).where("state_to is not null").groupBy(*keys, F.col("state").alias("state_from"), "state_to").agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "state_from")))


def leida_summary(states: DataFrame, sr: float, keys: list[str] = ("recording",)) -> DataFrame:
    """Rows (keys, switching_rate, switching_hz, entropy): share of steps that change state, and the occupancy-weighted entropy of transitions in bits."""
    w = Window.partitionBy(*keys).orderBy("idx")
    steps = states.withColumn("to", F.lead("state").over(w)).where("to is not null")
    rate = steps.groupBy(*keys).agg(F.avg((F.col("state") != F.col("to")).cast("double")).alias("switching_rate"))
    t = leida_transitions(states, keys)
    h = t.groupBy(*keys, F.col("state_from").alias("state")).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    total = Window.partitionBy(*keys)
    occupancy = states.groupBy(*keys, "state").agg(F.count("*").alias("m")).withColumn("o", F.col("m") / F.sum("m").over(total))
    entropy = occupancy.join(h, [*keys, "state"], "left").groupBy(*keys).agg(F.sum(F.col("o") * F.coalesce("h", F.lit(0.0))).alias("entropy"))
    return rate.join(entropy, list(keys)).select(*keys, "switching_rate", (F.col("switching_rate") * sr).alias("switching_hz"), "entropy")


def leida_dwell(states: DataFrame, sr: float = 1.0, keys: list[str] = ("recording",)) -> DataFrame:
    """Rows (keys, state, occupancy, mean_dwell, n_visits): runs of equal states, dwell in samples / sr."""
    w = Window.partitionBy(*keys).orderBy("idx")
    runs = states.withColumn("g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "state").orderBy("idx")))
    runs = runs.groupBy(*keys, "state", "g").agg(F.count("*").alias("length"))
    out = runs.groupBy(*keys, "state").agg(F.sum("length").alias("m"), (F.avg("length") / sr).alias("mean_dwell"), F.count("*").alias("n_visits"))
    return out.withColumn("occupancy", F.col("m") / F.sum("m").over(Window.partitionBy(*keys))).select(*keys, "state", "occupancy", "mean_dwell", "n_visits")
