"""SignalSet: several recordings (modalities) of uniformly sampled channels.

A thin holder of lazy DataFrames. samples: (modality, channel, idx, value);
channels: (modality, channel, sr, label, type); alignment: (modality, sr,
offset). Checks look at channel metadata only and run no job over samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, CHANNELS = ("modality", "channel", "idx", "value"), ("modality", "channel", "sr", "label", "type")


class SignalSet:
    def __init__(self, samples: DataFrame, channels: DataFrame, alignment: DataFrame | None = None, results: dict | None = None):
        for df, want, what in ((samples, SAMPLES, "samples"), (channels, CHANNELS, "channels")):
            missing = [c for c in want if c not in df.columns]
            if missing:
                raise ValueError(f"{what} lack {missing}")
        self.samples, self.channels, self.results = samples, channels, dict(results or {})
        self._alignment = alignment

    @classmethod
    def of(cls, samples: DataFrame, rates: dict[str, float], kinds: dict[str, str] | None = None) -> SignalSet:
        """From tall samples whose recording is the modality; channels are found in the data."""
        if not rates:
            raise ValueError("at least one modality is needed")
        rows = samples.withColumnRenamed("recording", "modality") if "recording" in samples.columns else samples
        lookup = lambda d, t: F.coalesce(*(F.when(F.col("modality") == k, F.lit(v)) for k, v in d.items())).cast(t)
        found = rows.select("modality", "channel").distinct()
        kind = lookup(kinds, "string") if kinds else F.lit(None).cast("string")
        return cls(rows.select(*SAMPLES), found.select("modality", "channel", lookup(rates, "double").alias("sr"), F.col("channel").alias("label"), kind.alias("type")))

    @property
    def alignment(self) -> DataFrame:
        """As given, or each modality's rate and an offset of 0. It is information only."""
        if self._alignment is not None:
            return self._alignment
        return self.channels.groupBy("modality").agg(F.first("sr").alias("sr")).withColumn("offset", F.lit(0.0))

    def with_alignment(self, alignment: DataFrame) -> SignalSet:
        return SignalSet(self.samples, self.channels, alignment, self.results)

    def modalities(self) -> DataFrame:
        """Names with their place in order."""
        names = self.channels.select("modality").distinct()
        return names.withColumn("place", F.row_number().over(Window.orderBy("modality")))

    def sampling_rates(self) -> DataFrame:
        return self.channels.groupBy("modality").agg(F.first("sr").alias("sr"))

    def n_modalities(self) -> DataFrame:
        return self.channels.agg(F.countDistinct("modality").alias("n_modalities"))

    def modality(self, name: str | int) -> SignalSet:
        """One member, by name or by place from 1."""
        if isinstance(name, int):
            row = self.modalities().where(F.col("place") == name).first()
            if row is None:
                raise KeyError(name)
            name = row["modality"]
        pick = F.col("modality") == name
        return SignalSet(self.samples.where(pick), self.channels.where(pick))

    def with_modality(self, name: str, samples: DataFrame, channels: DataFrame) -> SignalSet:
        """This set with a member replaced or added; cached results no longer hold and go."""
        others = F.col("modality") != name
        return SignalSet(
            self.samples.where(others).unionByName(samples.withColumn("modality", F.lit(name)).select(*SAMPLES)),
            self.channels.where(others).unionByName(channels.withColumn("modality", F.lit(name)).select(*CHANNELS)),
        )

    def slice(self, modalities: list[str] | None = None, tmin: float | None = None, tmax: float | None = None) -> SignalSet:
        """Members and the time range [tmin, tmax] in seconds, both ends included; indices start at 0 again.

        A range beyond a member's samples is an error; finding that out takes one pass over indices.
        """
        if tmin is not None and tmax is not None and tmin >= tmax:
            raise ValueError("tmin must be below tmax")
        channels = self.channels
        if modalities is not None:
            known = {r["modality"] for r in channels.select("modality").distinct().collect()}
            if unknown := set(modalities) - known:
                raise KeyError(f"unknown modalities {sorted(unknown)}")
            channels = channels.where(F.col("modality").isin(*modalities))
        samples = self.samples if modalities is None else self.samples.where(F.col("modality").isin(*modalities))
        if tmin is not None or tmax is not None:
            # one range for each modality, written as plain predicates so that it reaches the scan
            rates = {r["modality"]: r["sr"] for r in channels.groupBy("modality").agg(F.first("sr").alias("sr")).collect()}
            ends = {r["modality"]: r["last"] for r in samples.groupBy("modality").agg(F.max("idx").alias("last")).collect()}
            parts = []
            for name, sr in sorted(rates.items()):
                if ends.get(name) is not None and (((tmin or 0.0) * sr) // 1 > ends[name] or (tmax is not None and (tmax * sr) // 1 < 0)):
                    raise ValueError(f"the time range lies outside of {name!r}")
                first = max(0, int(((tmin or 0.0) * sr) // 1))
                part = samples.where((F.col("modality") == name) & (F.col("idx") >= first))
                if tmax is not None:
                    part = part.where(F.col("idx") <= int((tmax * sr) // 1))
                parts.append(part.withColumn("idx", F.col("idx") - first))
            samples = parts[0]
            for p in parts[1:]:
                samples = samples.unionByName(p)
        return SignalSet(samples, channels)

    def with_result(self, key: str, value) -> SignalSet:
        return SignalSet(self.samples, self.channels, self._alignment, self.results | {key: value})

    def __len__(self) -> int:
        return self.n_modalities().first()["n_modalities"]

    def __repr__(self) -> str:
        rows = self.channels.groupBy("modality").agg(F.count("*").alias("n"), F.first("sr").alias("sr")).orderBy("modality").collect()
        return "SignalSet: " + ", ".join(f"{r['modality']} ({r['n']} channels at {r['sr']:g} Hz)" for r in rows)
