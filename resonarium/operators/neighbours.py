"""Transfer entropy by nearest neighbours for signals of any length: slabs of values, and exact answers from the slabs next to them.

The embedded samples of a pair (the target's future, its past, the source's past)
are equal vectors added up and cut into slabs by the future's quantiles. Each slab
finds the distances to its own nearest points; where that bound reaches beyond
the slab, the slabs it reaches answer with what they have nearer, so the k-th
distance is exact. The counts within it are taken the same way, in slabs of the
target's latest past, which all three marginals share. Only points near a border
travel to more than one slab.

Slabs are SLAB points where that needs no more than SLABS of them. Values that
many samples share lie in one slab, however many there are; vectors that they
share are one point.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonarium.functions import neighbours
from resonarium.operators.packed import ordered_pairs
from resonarium.session import Scratch, ship

PAIR = ["recording", "channel_x", "channel_y"]
SLAB, SLABS = 20_000, 1024
#: Channels up to which their cuts are broadcast.
BROADCAST_CHANNELS = 2_000


def embedded(samples: DataFrame, length: int, delay: int) -> DataFrame:
    """Rows (recording, channel, t, future, past): values at t + delay and at t, t - 1, ..; complete ones only.

    Each sample goes to the times that it takes part in, so no task needs a whole
    signal in order.
    """
    roles = F.array(F.struct((F.col("idx") - delay).alias("t"), F.lit(-1).alias("role")), *(F.struct((F.col("idx") + d).alias("t"), F.lit(d).alias("role")) for d in range(length)))
    rows = samples.select("recording", "channel", F.col("value").cast("double").alias("value"), F.inline(roles))
    at = lambda r: F.max(F.when(F.col("role") == r, F.col("value")))
    rows = rows.groupBy("recording", "channel", "t").agg(F.count("*").alias("n"), at(-1).alias("future"), F.array(*map(at, range(length))).alias("past"))
    return rows.where(F.col("n") == length + 1).drop("n")


def slab_of(value: Column, cuts: Column) -> Column:
    """How many of the ascending cuts are at most the value."""
    steps = F.array(*(F.lit(1 << b) for b in range(SLABS.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda s, k: s + F.when(F.get(cuts, s + k - 1) <= value, k).otherwise(0))


def psi(n: Column) -> Column:
    """Digamma of whole numbers from 1 on."""
    x = n + F.lit(6.0)
    r = 1 / (x * x)
    out = F.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for j in range(6):
        out = out - 1 / (n + j)
    return out


def _lists(d: np.ndarray, like):
    """Rows of d as a column of arrays beside `like`, which may have no rows."""
    import pandas as pd

    return pd.Series(list(d), index=like.index, dtype=object)


def te_ksg(samples: DataFrame, k: int = 1, l: int = 1, delay: int = 1, knn: int = 4, slab: int = SLAB) -> DataFrame:  # noqa: E741
    """Rows (recording, channel_x, channel_y, te_xy, te_yx, net_te) in nats."""
    if min(k, l, delay, knn) < 1:
        raise ValueError("lags, delay and neighbours must be positive")
    spark = samples.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    rows = scratch.save(embedded(samples, max(k, l), delay))
    numbers = rows.groupBy("recording", "channel").agg(F.count("*").alias("n"))
    most = numbers.agg(F.max("n")).first()[0] or 0
    n_slabs = max(1, min(SLABS, -(-most // slab)))
    at = [i / n_slabs for i in range(1, n_slabs)]
    quantiles = F.percentile_approx("future", at, 100 * n_slabs) if at else F.array().cast("array<double>")
    cuts = rows.groupBy("recording", F.col("channel").alias("channel_y")).agg(F.array_distinct(quantiles).alias("cuts")) if at else numbers.select("recording", F.col("channel").alias("channel_y"), F.array().cast("array<double>").alias("cuts"))
    cuts = scratch.save(cuts)
    near_cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_CHANNELS else cuts
    z = [f"z{i}" for i in range(1 + k + l)]
    pairs = ordered_pairs(rows, ["future", "past"], ["recording", "t"], both=True)  # x is the source
    pairs = pairs.select(*PAIR, F.col("future_y").alias("z0"), *(F.get("past_y", F.lit(i)).alias(z[1 + i]) for i in range(k)), *(F.get("past_x", F.lit(i)).alias(z[1 + k + i]) for i in range(l)))
    pairs = pairs.groupBy(*PAIR, *z).agg(F.count("*").alias("w")).join(near_cuts, ["recording", "channel_y"])
    points = scratch.save(pairs.select(*PAIR, *z, "w", slab_of(F.col("z0"), F.col("cuts")).alias("slab"), slab_of(F.col("z1"), F.col("cuts")).alias("past_slab"), "cuts"))
    own = ", ".join(["recording string, channel_x string, channel_y string", *(f"{c} double" for c in z)])

    def inside(f):
        d = neighbours.nearest(f[z].to_numpy(), f["w"].to_numpy(), knn)
        return f[[*PAIR, *z, "w", "slab", "past_slab"]].assign(near=_lists(d, f))

    bare = points.drop("cuts")
    first = bare.groupBy(*PAIR, "slab").applyInPandas(inside, f"{own}, w long, slab int, past_slab int, near array<double>")
    first = scratch.save(first.join(near_cuts, ["recording", "channel_y"]).withColumn("reach", F.element_at("near", knn)))
    span = lambda v, r: F.sequence(slab_of(v - r, F.col("cuts")), slab_of(v + r, F.col("cuts")))
    asked = first.select(*PAIR, *z, "reach", "slab", F.explode(F.filter(span(F.col("z0"), F.col("reach")), lambda s: s != F.col("slab"))).alias("to"))
    asked = asked.select(*PAIR, *z, "reach", F.col("to").alias("slab"))

    def beside(p, q):
        d = neighbours.nearest_of(p[z].to_numpy(), p["w"].to_numpy(), q[z].to_numpy(), q["reach"].to_numpy(), knn)
        return q[[*PAIR, *z]].assign(near=_lists(d, q))

    answers = bare.groupBy(*PAIR, "slab").cogroup(asked.groupBy(*PAIR, "slab")).applyInPandas(beside, f"{own}, near array<double>")
    both = first.select(*PAIR, *z, "near").unionByName(answers).groupBy(*PAIR, *z).agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), knn).alias("eps"))
    ball = points.drop("slab", "past_slab", "w").join(both, [*PAIR, *z])
    ball = ball.select(*PAIR, *z, "eps", F.explode(span(F.col("z1"), F.col("eps"))).alias("past_slab"))
    ball = ball.toDF(*ball.columns)  # columns of its own, as both sides of what follows come from points

    def counted(p, q):
        a, w, b, reach = p[z].to_numpy(), p["w"].to_numpy(), q[z].to_numpy(), q["eps"].to_numpy()
        past, joint, source = list(range(1, 1 + k)), list(range(1 + k)), list(range(1, 1 + k + l))
        return q[[*PAIR, *z]].assign(**{name: neighbours.within(a[:, c], w, b[:, c], reach) for name, c in (("a", past), ("b", joint), ("c", source))})

    counts = bare.groupBy(*PAIR, "past_slab").cogroup(ball.groupBy(*PAIR, "past_slab")).applyInPandas(counted, f"{own}, a long, b long, c long")
    counts = counts.groupBy(*PAIR, *z).agg(*(F.greatest(F.sum(c), F.lit(1)).alias(c) for c in "abc"))
    terms = counts.join(bare.select(*PAIR, *z, "w"), [*PAIR, *z])
    te = terms.groupBy(*PAIR).agg((psi(F.lit(knn)) + F.sum(F.col("w") * (psi(F.col("a")) - psi(F.col("b")) - psi(F.col("c")))) / F.sum("w")).alias("te"))
    te = scratch.save(te)
    back = te.select("recording", F.col("channel_x").alias("channel_y"), F.col("channel_y").alias("channel_x"), F.col("te").alias("te_yx"))
    out = te.withColumnRenamed("te", "te_xy").where("channel_x < channel_y").join(back, PAIR)
    return out.select(*PAIR, "te_xy", "te_yx", (F.col("te_xy") - F.col("te_yx")).alias("net_te"))
