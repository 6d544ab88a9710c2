"""Short accounts of results for people: rows (position, line), made where the results are.

Each function takes what an operator returned. Numbers keep the digits that
matter for reading; whatever goes on from a result should use the result itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _told(df: DataFrame, form: str, *columns: Column | str, order: Column | None = None, first: int = 0) -> DataFrame:
    """One line a row of a small result, in the given order."""
    at = F.lit(first) if order is None else F.lit(first) + order
    return df.select(at.cast("int").alias("position"), F.format_string(form, *columns).alias("line"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _listed(column: str, form: str, by: str) -> Column:
    """Values of a small result after one another, in order of another column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.format_string(form, column).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), ", ")


def _by(key: str):
    return Window.orderBy(key)  # over results of a row a recording, block or pair


def states(rows: DataFrame) -> DataFrame:
    """Of leida_states: how many samples and states, and each state's share."""
    whole = rows.agg(F.count("*").alias("n"), F.countDistinct("state").alias("k"))
    shares = rows.groupBy("state").agg(F.count("*").alias("m")).join(F.broadcast(whole.select("n")), F.lit(True))
    return _all(_told(whole, "phase states: %d states over %d samples", "k", "n"), _told(shares, "  state %d: %.1f%% of the samples", "state", 100 * F.col("m") / F.col("n"), order=F.col("state")))


def transitions(rows: DataFrame, rate: DataFrame, key: str = "recording") -> DataFrame:
    """Of leida_transitions and leida_summary: a line for each key, ordered by it."""
    counted = rows.groupBy(key).agg(F.sum("n").alias("steps"), F.countDistinct("state_from").alias("k"))
    met = counted.join(rate, key)
    place = F.dense_rank().over(_by(key)) - 1
    return _told(met, "%s: %d steps between %d states, %.3f of them to another state, entropy %.3f bits", key, "steps", "k", "switching_rate", "entropy", order=place)


def association(row: DataFrame, value: str, name: str) -> DataFrame:
    """Of rv_coefficient (value rv), distance_correlation (dcor) or rv_test: one line."""
    p = F.format_string(", p = %.3f", "p_value") if "p_value" in row.columns else F.lit("")
    n = F.format_string(" over %d observations", "n") if "n" in row.columns else F.lit("")
    return row.select(F.lit(0).alias("position"), F.concat(F.lit(f"{name}: "), F.format_string("%.3f", value), n, p).alias("line"))


def similarity(rows: DataFrame) -> DataFrame:
    """Of representational_similarity: a line for each pair of blocks."""
    place = F.dense_rank().over(_by("pair")) - 1
    named = rows.withColumn("pair", F.concat_ws(" and ", "block_x", "block_y"))
    return _told(named, "distances of %s: %.3f alike", "pair", "similarity", order=place)


def factorization(starts: DataFrame, rank: int) -> DataFrame:
    """Of coupled_nmf: the best start."""
    best = starts.agg(F.min_by(F.struct("vaf_x", "vaf_y", "vaf", "iterations"), F.struct("resid", "restart")).alias("b"), F.count("*").alias("k"))
    return _told(best, f"coupled factors of rank {rank}: %.3f of the first block, %.3f of the second, %.3f of both after %d steps, best of %d starts", "b.vaf_x", "b.vaf_y", "b.vaf", "b.iterations", "k")


def joint_and_individual(shares: DataFrame) -> DataFrame:
    """Of jive's shares: what each block has in common, on its own, and left."""
    head = shares.agg(F.count("*").alias("k"), F.max("iterations").alias("i"))
    place = F.dense_rank().over(_by("block"))
    return _all(_told(head, "joint and individual parts of %d blocks after %d steps", "k", "i"), _told(shares, "  %s: joint %.1f%%, individual %.1f%%, left %.1f%%", "block", *(100 * F.col(c) for c in ("joint", "individual", "residual")), order=place))


def factors(rows: DataFrame) -> DataFrame:
    """Of multiple_factor_analysis: explained shares."""
    one = rows.withColumn("share", 100 * F.col("explained")).agg(F.count("*").alias("k"), _listed("share", "%.1f%%", "factor").alias("v"))
    return _told(one, "%d common factors of all blocks, explaining %s", "k", "v")


def canonical(pairs: DataFrame) -> DataFrame:
    """Of cca: the correlations of its pairs."""
    return _told(pairs.agg(F.count("*").alias("k"), _listed("cor", "%.3f", "pair").alias("v")), "%d canonical pairs, correlations %s", "k", "v")


def components(rows: DataFrame) -> DataFrame:
    """Of pls_blocks: the correlations of its scores."""
    return _told(rows.agg(F.count("*").alias("k"), _listed("correlation", "%.3f", "component").alias("v")), "%d components of two blocks, score correlations %s", "k", "v")


def index(rows: DataFrame, mean_index: float = 100) -> DataFrame:
    """Of deviation_index: the range of the whole index."""
    one = rows.where("part = 'all'").agg(F.count("*").alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    return _told(one, f"deviation index of %d observations from %.1f to %.1f, the reference about {mean_index:.0f}", "n", "lo", "hi")


def fused(rows: DataFrame, places: DataFrame, method: str) -> DataFrame:
    """Of fuse_blocks: its size."""
    one = places.agg(F.max("end").alias("p"), F.count("*").alias("k")).join(rows.agg(F.count("*").alias("n")), F.lit(True))
    return _told(one, f"%d blocks fused ({method}): %d observations of %d features", "k", "n", "p")


def shared_factors(rows: DataFrame) -> DataFrame:
    """Of cross_block_factor's factors."""
    return _told(rows.agg(F.count("*").alias("k"), F.count_if("shared").alias("s")), "%d factors, %d of them in two blocks or more", "k", "s")


def cross_wavelet(rows: DataFrame) -> DataFrame:
    """Of cross_wavelet: a line for each pair of channels."""
    pair = F.concat_ws(" and ", "channel_x", "channel_y").alias("pair")
    told = F.avg(F.col("significant").cast("double")) if "significant" in rows.columns else F.lit(None).cast("double")
    one = rows.groupBy(pair).agg(F.countDistinct("frequency").alias("f"), F.count("*").alias("m"), F.max_by("frequency", "power").alias("top"), told.alias("s"))
    line = F.concat(F.format_string("%s: %d frequencies, %d values, most power at %.3f", "pair", "f", "m", "top"), F.when(F.col("s").isNotNull(), F.format_string(", %.1f%% significant", 100 * F.col("s"))).otherwise(""))
    return one.select((F.dense_rank().over(_by("pair")) - 1).cast("int").alias("position"), line.alias("line"))
