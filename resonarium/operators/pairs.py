"""Pairs of two recordings: channels of one against channels of another, brought to one rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.functions import filters
from resonarium.model import SignalSet
from resonarium.operators.packed import map_rows, pack, unpack

X, Y = "x:", "y:"


def chosen(s: SignalSet, modality: str, channels: list[str] | None) -> tuple[DataFrame, float]:
    """Tall samples (channel, idx, value) of a member's channels, and its rate."""
    rates = s.channels.where(F.col("modality") == modality).select("channel", "sr").collect()  # as many rows as channels
    if not rates:
        raise ValueError(f"{modality!r} is not a member of the set")
    if channels is not None and (unknown := set(channels) - {r["channel"] for r in rates}):
        raise ValueError(f"{modality!r} has no channels {sorted(unknown)}")
    if len({r["sr"] for r in rates}) > 1:
        raise ValueError(f"{modality!r} has several rates")
    rows = s.samples.where(F.col("modality") == modality)
    if channels is not None:
        rows = rows.where(F.col("channel").isin(*channels))
    return rows.select("channel", "idx", "value"), rates[0]["sr"]


def matched(s: SignalSet, modality_x: str, modality_y: str, channels_x: list[str] | None = None, channels_y: list[str] | None = None, kind: str = "butter") -> tuple[DataFrame, float]:
    """(samples, sr): both members' channels as one recording, named x:<channel> and y:<channel>, at the rate of x and of common length.

    y is filtered below 0.9 times half the rate of x where it is faster, then
    resampled linearly in time, once a channel; members of equal rate are left
    as they are but for their length.
    """
    (x, sr_x), (y, sr_y) = chosen(s, modality_x, channels_x), chosen(s, modality_y, channels_y)
    name = f"{modality_x}|{modality_y}"
    named = lambda df, p: df.select(F.lit(name).alias("recording"), F.concat(F.lit(p), "channel").alias("channel"), "idx", "value")
    x, y = named(x, X), named(y, Y)
    if abs(sr_x - sr_y) > 1e-6:

        def kernel(recording, channel, v):
            return {"v": filters.at_rate(v, sr_y, sr_x, kind)}

        y = unpack(map_rows(pack(y, name="v"), kernel, "v array<double>", ["recording", "channel"]), "v")
    both = x.unionByName(y.withColumn("idx", F.col("idx").cast("long")))
    n = both.groupBy("recording", "channel").agg(F.max("idx").alias("last")).groupBy("recording").agg(F.min("last").alias("_last"))
    return both.join(n, "recording").where(F.col("idx") <= F.col("_last")).drop("_last"), sr_x


def between(rows: DataFrame) -> DataFrame:
    """Of a result for all pairs of `matched` channels those of an x and a y channel, under their own names."""
    rows = rows.where(F.col("channel_x").startswith(X) & F.col("channel_y").startswith(Y))
    return rows.withColumns({c: F.substring(c, len(X) + 1, 1 << 30) for c in ("channel_x", "channel_y")})


def one_recording_a_pair(samples: DataFrame) -> DataFrame:
    """Each x and y channel as a recording of their own, for models of a whole recording."""
    x, y = samples.where(F.col("channel").startswith(X)), samples.where(F.col("channel").startswith(Y))
    names = lambda df: F.broadcast(df.groupBy().agg(F.collect_set("channel").alias("_other")))  # noqa: E731  as many as channels
    spread = lambda df, others, a, b: df.crossJoin(names(others)).withColumn("_other", F.explode("_other")).select(F.concat_ws("|", "recording", a, b).alias("recording"), "channel", "idx", "value")
    return spread(x, y, "channel", "_other").unionByName(spread(y, x, "_other", "channel"))
