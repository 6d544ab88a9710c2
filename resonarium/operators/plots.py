"""What plots show, as tidy DataFrames; cells keep the keys they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coupling_matrix_frame(matrix: DataFrame, value: str = "value") -> DataFrame:
    """Rows (row, column, value) from (channel_x, channel_y, value)."""
    return matrix.select(F.col("channel_x").alias("row"), F.col("channel_y").alias("column"), F.col(value).alias("value"))


def coherence_spectrum_frame(spectrum: DataFrame) -> DataFrame:
    """Rows (pair, frequency, coherence, limit)."""
    return spectrum.select(F.concat_ws("-", "channel_x", "channel_y").alias("pair"), "frequency", "coherence", F.col("confidence").alias("limit"))


def coupling_timecourse_frame(sliding: DataFrame) -> DataFrame:
    """Rows (pair, time, peak): the correlation of largest size in each window."""
    best = F.struct(F.abs("correlation").alias("v"), (-F.col("lag")).alias("l"))
    return sliding.groupBy("recording", "channel_x", "channel_y", "win", "time").agg(F.max_by("correlation", best).alias("peak")).select(F.concat_ws("-", "channel_x", "channel_y").alias("pair"), "time", "peak")


def wavelet_coherence_frame(coherence: DataFrame, value: str = "coherence") -> DataFrame:
    """Rows (pair, time, frequency, value, coi); the cone is cut at the highest frequency of its pair."""
    top = coherence.groupBy("recording", "channel_x", "channel_y").agg(F.max("frequency").alias("_top"))
    rows = coherence.join(top, ["recording", "channel_x", "channel_y"])
    return rows.select(F.concat_ws("-", "channel_x", "channel_y").alias("pair"), "time", "frequency", F.col(value).alias("value"), F.least("coi", "_top").alias("coi"))


def comodulogram_frame(grid: DataFrame, mask: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Rows (phase_freq, amp_freq, pac, opacity): 1 where a mask (significant, or p_value at most alpha) holds or none is given, else 0.3."""
    if mask is None:
        return grid.select("phase_freq", "amp_freq", "pac", F.lit(1.0).alias("opacity"))
    on = F.col("significant") if "significant" in mask.columns else F.col("p_value") <= alpha
    held = mask.select("phase_freq", "amp_freq", on.alias("_on"))
    return grid.join(held, ["phase_freq", "amp_freq"]).select("phase_freq", "amp_freq", "pac", F.when(F.col("_on"), 1.0).otherwise(0.3).alias("opacity"))
