"""Resampling tests: (pair, replicate) rows carry a seed, kernels draw, Spark counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonarium.functions import resampling as R
from resonarium.operators.packed import map_rows, ordered_pairs, pack

PAIR = ["recording", "channel_x", "channel_y"]


def quantile8(values: Column, q: float) -> Column:
    """Median-unbiased quantile of a sorted array."""
    n = F.size(values)
    h = (n + 1 / 3) * q + 1 / 3
    k = F.floor(h + 1e-15)
    at = lambda i: F.get(values, F.least(n - 1, F.greatest(F.lit(0), i - 1)).cast("int"))
    w = h - k
    return F.when(F.abs(w) < 1e-12, at(k)).otherwise((1 - w) * at(k) + w * at(k + 1))


def adjusted(df: DataFrame, p: str, keys: list[str], method: str = "BH", name: str = "p_adjusted") -> DataFrame:
    """Adds adjusted p-values over the rows of each `keys` group. Nulls stay and don't count; hommel runs a kernel on a group's p-values."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    m = F.count(p).over(part)
    if method == "none":
        return df.withColumn(name, F.col(p))
    if method == "bonferroni":
        return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m)))
    if method == "hommel":
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

        def run(pdf):
            return pdf.assign(**{name: R.adjust(pdf[p].to_numpy(float), "hommel")})

        return (df.groupBy(*keys) if keys else df.groupBy()).applyInPandas(run, schema)
    order = F.when(F.col(p).isNotNull(), F.row_number().over(part.orderBy(F.col(p).asc_nulls_last())))
    ranked = df.withColumn("_r", order).withColumn("_m", m)
    if method == "BY":
        ranked = ranked.withColumn("_h", F.sum(1 / F.col("_r")).over(part))  # once for a group
    if method in ("holm",):
        value = F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(part.orderBy(F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    else:
        factor = {"BH": F.col("_m") / F.col("_r"), "fdr": F.col("_m") / F.col("_r"), "hochberg": F.col("_m") - F.col("_r") + 1, "BY": F.col("_m") / F.col("_r") * F.col("_h")}.get(method)
        if factor is None:
            raise ValueError(f"unknown method {method!r}")
        value = F.min(factor * F.col(p)).over(part.orderBy(F.col("_r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), value))).drop("_r", "_m", "_h")


def shifted(samples: DataFrame, shifts: DataFrame, n: int) -> DataFrame:
    """Rows (rep, keys of samples, idx, value) of signals of n samples moved round by given shifts (rep, shift): out[i] = in[(i + shift) mod n]."""
    return samples.crossJoin(F.broadcast(shifts)).withColumn("idx", F.pmod(F.col("idx") - F.col("shift"), F.lit(n)))


def boot_rows(samples: DataFrame, starts: DataFrame, block: int, n: int) -> DataFrame:
    """Rows (rep, pos, keys, value) of block resamples from given starts (rep, k, start): position k * block + j reads start + j."""
    at = starts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select("rep", (F.col("k") * block + F.col("j")).alias("pos"), (F.col("start") + F.col("j")).alias("idx")).where(F.col("pos") < n)
    return at.join(samples, "idx").drop("idx")


#: Replicates that one task row draws from a pair of signals.
CHUNK = 25
Stat = Callable[[np.ndarray, np.ndarray], float]


def _replicates(samples: DataFrame, n: int, statistic: Stat, draw: Callable, seed: int) -> DataFrame:
    """Rows (pair, rep, stat); rep -1 is the observed one. A pair's signals are sent once for each CHUNK replicates."""
    rows = ordered_pairs(pack(samples), ["x"]).withColumn("first", F.explode(F.sequence(F.lit(-1), F.lit(max(-1, n - 1)), F.lit(CHUNK))))
    spark = samples.sparkSession
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, *PAIR, "first")

    def kernel(x_x, x_y, first, **_):
        m = min(len(x_x), len(x_y))
        for rep in range(first, min(first + CHUNK, n)):
            x, y = x_x[:m], x_y[:m]
            if rep >= 0:
                x, y = draw(x, y, R.rng_of(seed, rep))
            yield {"rep": rep, "stat": float(statistic(x, y))}

    return map_rows(rows, kernel, "rep int, stat double", PAIR)


def surrogate_test(samples: DataFrame, statistic: Stat, n_surrogates: int = 199, surrogate: str = "phase", seed: int = 0) -> DataFrame:
    """Rows (recording, channel_x, channel_y, observed, p_value, threshold_95, null_mean, null_sd); only y is drawn anew.

    Draws depend on (seed, replicate), not on partitions or cores.
    """
    if surrogate not in R.SURROGATES:
        raise ValueError(f"unknown surrogate {surrogate!r}")
    rows = _replicates(samples, n_surrogates, statistic, lambda x, y, rng: (x, R.SURROGATES[surrogate](y, rng)), seed)
    return surrogate_summary(rows)


def surrogate_summary(rows: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    null = F.when(F.col("rep") >= 0, F.col("stat"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("observed", F.max(F.when(F.col("rep") < 0, F.col("stat"))).over(w))
    above = F.sum(F.when((F.col("rep") >= 0) & (F.col("stat") >= F.col("observed")), 1).otherwise(0))
    return rows.groupBy(*keys).agg(F.max("observed").alias("observed"), ((above + 1) / (F.count(null) + 1)).alias("p_value"), F.percentile(null, 0.95).alias("threshold_95"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"))


def bootstrap_ci(samples: DataFrame, statistic: Stat, n_boot: int = 199, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Rows (recording, channel_x, channel_y, observed, lower, upper): percentile interval of a paired block bootstrap."""

    def draw(x, y, rng):
        k = R.block_index(len(x), rng)
        return x[k], y[k]

    rows = _replicates(samples, n_boot, statistic, draw, seed)
    null = F.when(F.col("rep") >= 0, F.col("stat"))
    return rows.groupBy(*PAIR).agg(F.max(F.when(F.col("rep") < 0, F.col("stat"))).alias("observed"), F.percentile(null, (1 - ci) / 2).alias("lower"), F.percentile(null, 1 - (1 - ci) / 2).alias("upper"))


def surrogate_matrix_test(samples: DataFrame, statistic: Stat, n_surrogates: int = 199, surrogate: str = "phase", p_adjust: str = "fdr", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """surrogate_test for all pairs in one job, with adjusted p-values and significance (strictly below alpha)."""
    if p_adjust not in ("fdr", "BH", "bonferroni", "none"):
        raise ValueError(f"unknown adjustment {p_adjust!r}")
    return adjusted(surrogate_test(samples, statistic, n_surrogates, surrogate, seed), "p_value", [], p_adjust).withColumn("significant", F.col("p_adjusted") < alpha)
