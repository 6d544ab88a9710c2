"""Sources of samples: event tables on a regular grid, files, and generators.

All give tall samples (recording, channel, idx, value).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def event_grid(spark: SparkSession, sf_dir: str, minutes: int = 60, days: int = 30, agg: str = "sum") -> DataFrame:
    """Events summed (or counted) in buckets of `minutes`; every channel has every bucket, empty ones 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts")
    since = (F.datediff(F.to_date(ts), F.lit(ORIGIN).cast("date")) * 1440 + F.hour(ts) * 60 + F.minute(ts)) / minutes
    n = days * 1440 // minutes
    rows = events.select(F.col("event_type").alias("channel"), F.floor(since).cast("long").alias("idx"), "value").where(F.col("idx").between(0, n - 1))
    filled = rows.groupBy("channel", "idx").agg((F.sum("value") if agg == "sum" else F.count("*").cast("double")).alias("value"))
    grid = rows.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("idx"))
    return grid.join(filled, ["channel", "idx"], "left").select(F.lit("events").alias("recording"), "channel", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def from_wide(df: DataFrame, idx: str, recording: str, channels: list[str]) -> DataFrame:
    """Columns of a table as channels."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels))).alias("p")
    return df.select(F.lit(recording).alias("recording"), F.col(idx).cast("long").alias("idx"), pairs).select("recording", "p.channel", "idx", "p.value")


def read_samples(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Tall samples from Parquet, or from CSV with a header."""
    schema = "recording string, channel string, idx long, value double"
    return spark.read.schema(schema).option("header", True).format(kind).load(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet laid out by recording, sorted so that slices by channel and time prune row groups."""
    samples.repartition("recording", "channel").sortWithinPartitions("channel", "idx").write.partitionBy("recording").parquet(path)


def _grid(spark: SparkSession, recording: str, channel: str, n: int, value: Column) -> DataFrame:
    return spark.range(n).select(F.lit(recording).alias("recording"), F.lit(channel).alias("channel"), F.col("id").alias("idx"), value.alias("value"))


def _tone(f: float, duration: float, n: int) -> Column:
    """A sine on n points that include both ends of the duration."""
    return F.sin(F.col("id") * (2 * math.pi * f * duration / max(1, n - 1)))


def coupled_signals(spark: SparkSession, sr1: float = 500, sr2: float = 500, coupling_freq: float = 20, coupling_strength: float = 0.8, noise: float = 0.2, duration: float = 10, seed: int = 0) -> DataFrame:
    """Two channels that share a sine, each with noise of its own."""
    out = []
    for k, (name, sr) in enumerate((("x", sr1), ("y", sr2))):
        n = round(sr * duration)
        out.append(_grid(spark, name, name, n, coupling_strength * _tone(coupling_freq, duration, n) + noise * F.randn(seed + k)))
    return out[0].unionByName(out[1])


def eeg_emg(spark: SparkSession, n_sec: float = 10, n_eeg: int = 3, n_emg: int = 2, sr_eeg: float = 500, sr_emg: float = 1000, cmc_freq: float = 20, seed: int = 0) -> DataFrame:
    """Two recordings; the first channel of each carries a common sine."""
    out = None
    for k, (rec, count, sr, sd) in enumerate((("EEG", n_eeg, sr_eeg, 1.0), ("EMG", n_emg, sr_emg, 0.5))):
        n = round(sr * n_sec)
        for c in range(count):
            v = sd * F.randn(seed + 100 * k + c) + (0.7 * _tone(cmc_freq, n_sec, n) if c == 0 else F.lit(0.0))
            df = _grid(spark, rec, f"{rec}{c + 1}", n, v)
            out = df if out is None else out.unionByName(df)
    return out


def directed_signals(spark: SparkSession, n: int = 5000, lag_samples: int = 10, coupling: float = 0.7, seed: int = 0) -> DataFrame:
    """y follows x after `lag_samples`; its first samples are 0. Noise is a hash of the index, so the lag needs no window."""

    def noise(i: Column, stream: int) -> Column:
        u = lambda s: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(s)), F.lit(2**52)).cast("double") + 0.5) / 2**52
        return F.sqrt(-2 * F.log(u(2 * stream))) * F.cos(2 * math.pi * u(2 * stream + 1))

    i = F.col("id")
    x = _grid(spark, "pair", "x", n, noise(i, 0))
    y = F.when(i >= lag_samples, coupling * noise(i - lag_samples, 0) + (1 - coupling) * noise(i, 1)).otherwise(0.0)
    return x.unionByName(_grid(spark, "pair", "y", n, y))


def own_grid(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Events summed in buckets of `minutes` from the first event to the last; every channel has every bucket, empty ones 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts IS NOT NULL")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(minutes * 60_000_000)).cast("long")
    first, last = events.agg(F.min(bucket), F.max(bucket)).first()
    rows = events.groupBy(F.col("event_type").alias("channel"), (bucket - F.lit(first)).alias("idx")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    if first is None:
        return rows.select(F.lit("events").alias("recording"), "channel", "idx", "value")
    grid = rows.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last - first).cast("long"))).alias("idx"))
    return grid.join(rows, ["channel", "idx"], "left").select(F.lit("events").alias("recording"), "channel", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
