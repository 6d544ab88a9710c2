"""Fourier transforms of signals of any length, in four steps over two keyed transposes.

With n = n1 * n2, j = n2 * j1 + j2 and k = k1 + n1 * k2, the transform of n points
is n2 transforms of n1 points (over j1), a twiddle exp(-2 pi i j2 k1 / n), and n1
transforms of n2 points (over j2). A row holds some columns j2 with all j1, or
some k1 with all k2: at most ROW numbers, however long the signal is. Between the
two, rows are cut into tiles that are dealt by the other index. The inverse goes
back the same way, so a filter by the spectrum is three exchanges of the signal.

Lengths with no factor near their root (a large prime, say) go through a chirp: a
convolution at the next power of two, whose own spectrum is made the same way and
joined by row.

A gap in a signal counts as zeros. Frequencies are numbered 0 to n - 1, those above
n / 2 being negative.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions import filters
from resonarium.operators.packed import map_groups, map_rows
from resonarium.session import Scratch, ship

SIGNAL = ["recording", "channel"]
#: Complex numbers in a row, at most, where the length allows.
ROW = 1 << 18
#: Signals up to which their lengths are broadcast.
BROADCAST_SIGNALS = 100_000
SHAPE = ["n", "n1", "n2", "w", "h"]
ROWS = [*SIGNAL, *SHAPE, "r"]


def shape(n: int, row: int = ROW) -> dict:
    """n1 * n2 = n with n1 the largest divisor up to the root; w columns or h rows in a row of data."""
    n1 = next(d for d in range(int(n**0.5) + 1, 0, -1) if n % d == 0 and d * d <= n)
    n2 = n // n1
    return {"n": n, "n1": n1, "n2": n2, "w": max(1, min(n2, row // n1)), "h": max(1, min(n1, row // n2))}


def lengths(samples: DataFrame, scratch: Scratch, row: int = ROW, of: Callable[[int], int] = int) -> DataFrame:
    """Rows (recording, channel, n, n1, n2, w, h), one a signal."""
    found = samples.groupBy(*SIGNAL).agg((F.max("idx") + 1).alias("size"))
    return scratch.save(map_rows(found, lambda size, **_: shape(of(size), row), ", ".join(f"{c} long" for c in SHAPE), SIGNAL))


def shaped(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their signal's lengths, which are a row a signal."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_SIGNALS else table, SIGNAL)


def _matrix(re: np.ndarray, im: np.ndarray, cuts: list[tuple[int, int]], across: bool) -> np.ndarray:
    """Tiles one after the other put side by side (across) or below each other."""
    z, at, out = re + 1j * im, 0, []
    for a, b in cuts:
        out.append(z[at : at + a * b].reshape(a, b))
        at += a * b
    return np.concatenate(out, 1 if across else 0)


def _twiddle(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-2j * np.pi * ((rows[:, None] * columns[None, :]) % n) / n)


def _spans(total: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(total, a + size)) for a in range(0, total, size)]


def forward(samples: DataFrame, table: DataFrame, re: str = "re", im: str = "im") -> DataFrame:
    """Rows (.., r, re, im): the spectrum at k1 + n1 * k2 for the h values of k1 from r * h on, k2 running fastest."""
    ship(samples.sparkSession)
    tall = shaped(samples.select(*SIGNAL, "idx", F.col(re).cast("double").alias("re"), F.col(im).cast("double").alias("im")), table)
    column = F.floor((F.col("idx") % F.col("n2")) / F.col("w")).cast("long").alias("c")
    tall = tall.groupBy(*SIGNAL, *SHAPE, column).agg(F.collect_list(F.struct("idx", "re", "im")).alias("s"))

    def columns(n, n1, n2, w, h, c, idx, re, im, **_):
        first = c * w
        m = np.zeros((n1, min(w, n2 - first)), complex)
        j = idx.astype(np.int64)
        m[j // n2, j % n2 - first] = re + 1j * im
        m = np.fft.fft(m, axis=0) * _twiddle(np.arange(n1), np.arange(first, first + m.shape[1]), n)
        return [{"r": r, "c": c, "re": m[a:b].real, "im": m[a:b].imag} for r, (a, b) in enumerate(_spans(n1, h))]

    packed = tall.select(*SIGNAL, *SHAPE, "c", F.col("s.idx").alias("idx"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))
    tiles = map_groups(packed, columns, "r long, c long, re array<double>, im array<double>", [*SIGNAL, *SHAPE], ["re", "im"])
    met = tiles.groupBy(*ROWS).agg(F.array_sort(F.collect_list(F.struct("c", "re", "im"))).alias("t"))

    def rows(n1, n2, w, h, r, re, im, **_):
        tall_by = min(h, n1 - r * h)
        m = np.fft.fft(_matrix(re, im, [(tall_by, b - a) for a, b in _spans(n2, w)], True), axis=1)
        return [{"re": m.real, "im": m.imag}]

    met = met.select(*ROWS, F.flatten("t.re").alias("re"), F.flatten("t.im").alias("im"))
    return map_groups(met, rows, "re array<double>, im array<double>", ROWS, ["re", "im"])


def numbers(n1: int, n2: int, h: int, r: int) -> np.ndarray:
    """The frequencies of a row of `forward`."""
    k1 = np.arange(r * h, min(n1, (r + 1) * h))
    return (k1[:, None] + n1 * np.arange(n2)[None, :]).ravel()


def changed(spectra: DataFrame, kernel: Callable) -> DataFrame:
    """Each row's spectrum z replaced by kernel(k, z, row)."""

    def run(re, im, n1, n2, h, r, **more):
        z = kernel(numbers(n1, n2, h, r), re + 1j * im, {"n1": n1, "n2": n2, "h": h, "r": r} | more)
        return [{"re": z.real, "im": z.imag}]

    return map_groups(spectra, run, "re array<double>, im array<double>", ROWS, ["re", "im"])


def inverse(spectra: DataFrame) -> DataFrame:
    """Rows (recording, channel, idx, re, im) of spectra in the layout of `forward`."""

    def rows(n, n1, n2, w, h, r, re, im, **_):
        first = r * h
        m = np.fft.ifft((re + 1j * im).reshape(-1, n2), axis=1)
        m = m * _twiddle(np.arange(first, first + len(m)), np.arange(n2), n).conj()
        return [{"c": c, "r": r, "re": m[:, a:b].real, "im": m[:, a:b].imag} for c, (a, b) in enumerate(_spans(n2, w))]

    tiles = map_groups(spectra, rows, "c long, r long, re array<double>, im array<double>", [*SIGNAL, *SHAPE], ["re", "im"])
    met = tiles.groupBy(*SIGNAL, *SHAPE, "c").agg(F.array_sort(F.collect_list(F.struct("r", "re", "im"))).alias("t"))

    def columns(n1, n2, w, h, c, re, im, **_):
        first, wide = c * w, min(w, n2 - c * w)
        m = np.fft.ifft(_matrix(re, im, [(b - a, wide) for a, b in _spans(n1, h)], False), axis=0)
        idx = n2 * np.arange(n1)[:, None] + np.arange(first, first + wide)[None, :]
        return [{"idx": idx, "re": m.real, "im": m.imag}]

    met = met.select(*SIGNAL, *SHAPE, "c", F.flatten("t.re").alias("re"), F.flatten("t.im").alias("im"))
    out = map_groups(met, columns, "idx array<double>, re array<double>, im array<double>", SIGNAL, ["idx", "re", "im"])
    tall = out.select(*SIGNAL, F.explode(F.arrays_zip("idx", "re", "im")).alias("z"))
    return tall.select(*SIGNAL, F.col("z.idx").cast("long").alias("idx"), "z.re", "z.im")


def chirp(j: np.ndarray, n: int, sign: int) -> np.ndarray:
    """exp(sign * pi * i * j**2 / n), the square taken modulo 2 n; right for n below 2**31."""
    j = j.astype(np.int64)
    return np.exp(sign * 1j * np.pi * ((j * j) % (2 * n)) / n)


def _tall(samples: DataFrame, table: DataFrame, kernel: Callable) -> DataFrame:
    """Complex samples with values z replaced by kernel(idx, z, size); table: rows (recording, channel, size)."""
    ship(samples.sparkSession)
    joined = samples.select(*SIGNAL, "idx", "re", "im").join(F.broadcast(table) if table.count() <= BROADCAST_SIGNALS else table, SIGNAL)

    def run(frames):
        for f in frames:
            for size, g in f.groupby("size"):
                z = kernel(g["idx"].to_numpy(), g["re"].to_numpy() + 1j * g["im"].to_numpy(), int(size))
                yield g.assign(re=z.real, im=z.imag)[[*SIGNAL, "idx", "re", "im"]]

    return joined.mapInPandas(run, "recording string, channel string, idx long, re double, im double")


def by_chirp(samples: DataFrame, sizes: DataFrame, sign: int, scratch: Scratch, row: int = ROW) -> DataFrame:
    """Unscaled sums of z * exp(sign * 2 pi i j k / size) for any size, as complex samples numbered k.

    sizes: rows (recording, channel, size). A convolution with a chirp at a power of two.
    """
    padded = lambda size: 1 << int(2 * size - 1).bit_length()
    table = scratch.save(map_rows(sizes, lambda size, **_: shape(padded(size), row), ", ".join(f"{c} long" for c in SHAPE), SIGNAL))
    turned = _tall(samples, sizes, lambda j, z, n: z * chirp(j, n, sign))
    ends = sizes.select(*SIGNAL, F.explode(F.sequence(1 - F.col("size"), F.col("size") - 1)).alias("idx"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    wave = _tall(ends, sizes, lambda j, z, n: chirp(j, n, -sign))
    wave = shaped(wave, table).select(*SIGNAL, F.pmod("idx", "n").alias("idx"), "re", "im")
    answer = scratch.save(forward(wave, table).select(*ROWS, F.col("re").alias("wre"), F.col("im").alias("wim")))
    both = forward(turned, table).join(answer, ROWS)
    made = inverse(changed(both, lambda k, z, row: z * (row["wre"] + 1j * row["wim"])))
    made = made.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SIGNALS else sizes, SIGNAL).where(F.col("idx") < F.col("size")).drop("size")
    return _tall(made, sizes, lambda k, z, n: z * chirp(k, n, sign))


def through_spectrum(samples: DataFrame, gain: Callable, row: int = ROW, value: str = "value") -> DataFrame:
    """Rows (recording, channel, idx, re, im): signals whose spectra were multiplied by gain(k, n), an array for an array k."""
    scratch = Scratch(samples.sparkSession, "fourier")
    tall = samples.select(*SIGNAL, "idx", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    table = lengths(samples, scratch, row)
    even, odd = table.where(F.col("n2") <= row), table.where(F.col("n2") > row)
    apply = lambda k, z, at: z * gain(k, at["n1"] * at["n2"])
    out = inverse(changed(forward(tall, even), apply))
    if odd.limit(1).count():
        sizes = odd.select(*SIGNAL, F.col("n").alias("size"))
        there = by_chirp(tall.join(odd.select(*SIGNAL), SIGNAL, "left_semi"), sizes, -1, scratch, row)
        there = scratch.save(_tall(there, sizes, lambda k, z, n: z * gain(k, n) / n))
        out = out.unionByName(by_chirp(there, sizes, 1, scratch, row))
    return out


def spectrum(samples: DataFrame, row: int = ROW, value: str = "value") -> DataFrame:
    """Rows (recording, channel, k, re, im): the unscaled transform of signals of any length."""
    scratch = Scratch(samples.sparkSession, "spectrum")
    tall = samples.select(*SIGNAL, "idx", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    table = lengths(samples, scratch, row)
    own = map_groups(forward(tall, table.where(F.col("n2") <= row)), lambda re, im, n1, n2, h, r, **_: [{"k": numbers(n1, n2, h, r), "re": re, "im": im}], "k array<double>, re array<double>, im array<double>", SIGNAL, ["k", "re", "im"])
    own = own.select(*SIGNAL, F.explode(F.arrays_zip("k", "re", "im")).alias("z")).select(*SIGNAL, F.col("z.k").cast("long").alias("k"), "z.re", "z.im")
    odd = table.where(F.col("n2") > row)
    if odd.limit(1).count():
        there = by_chirp(tall.join(odd.select(*SIGNAL), SIGNAL, "left_semi"), odd.select(*SIGNAL, F.col("n").alias("size")), -1, scratch, row)
        own = own.unionByName(there.withColumnRenamed("idx", "k"))
    return own


def half_line(k: np.ndarray, n: int) -> np.ndarray:
    """Gain of the analytic signal: positive frequencies twice, 0 and n / 2 once."""
    return np.where(k == 0, 1.0, np.where(2 * k < n, 2.0, np.where(2 * k == n, 1.0, 0.0)))


def hilbert(samples: DataFrame, row: int = ROW) -> DataFrame:
    """The analytic signal, rows (recording, channel, idx, re, im), of signals of any length."""
    return through_spectrum(samples, half_line, row)


def ideal_band(samples: DataFrame, sr: float, band: tuple[float, float], analytic: bool = False, row: int = ROW) -> DataFrame:
    """The frequencies from band[0] to band[1] alone, edges included; as an analytic signal if asked."""
    filters.check_band(band[0], band[1], sr)

    def gain(k, n):
        f = np.minimum(k, n - k) * sr / n
        keep = ((f >= band[0]) & (f <= band[1])).astype(float)
        return keep * half_line(k, n) if analytic else keep

    return through_spectrum(samples, gain, row)


def _uniform(k: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each whole number k, by mixing its bits with the seed."""
    with np.errstate(over="ignore"):
        z = k.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) / float(1 << 53)


def phase_randomized(samples: DataFrame, seed: int = 0, row: int = ROW) -> DataFrame:
    """Surrogates with the amplitudes of the signals' spectra and phases that follow from (seed, frequency) alone.

    Rows (recording, channel, idx, value). Negative frequencies have the
    conjugates, 0 and n / 2 have phase 0. Channels get the same phases.
    """
    return amplitudes_kept(samples, lambda k, n: random_phase(k, n, seed), row)


def amplitudes_kept(samples: DataFrame, phase: Callable, row: int = ROW) -> DataFrame:
    """Signals with the amplitudes of their own spectra and the phases phase(k, n); rows (recording, channel, idx, value)."""
    scratch = Scratch(samples.sparkSession, "phases")
    tall = samples.select(*SIGNAL, "idx", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    table = lengths(samples, scratch, row)
    apply = lambda k, z, n: np.abs(z) * np.exp(1j * phase(k, n))
    out = inverse(changed(forward(tall, table.where(F.col("n2") <= row)), lambda k, z, at: apply(k, z, at["n1"] * at["n2"])))
    odd = table.where(F.col("n2") > row)
    if odd.limit(1).count():
        sizes = odd.select(*SIGNAL, F.col("n").alias("size"))
        there = by_chirp(tall.join(odd.select(*SIGNAL), SIGNAL, "left_semi"), sizes, -1, scratch, row)
        there = scratch.save(_tall(there, sizes, lambda k, z, n: apply(k, z, n) / n))
        out = out.unionByName(by_chirp(there, sizes, 1, scratch, row))
    return out.select(*SIGNAL, "idx", F.col("re").alias("value"))


def random_phase(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    own = 2 * np.pi * _uniform(np.minimum(k, n - k), seed)
    return np.where((k == 0) | (2 * k == n), 0.0, np.where(2 * k < n, own, -own))


def ranked(values: DataFrame, scratch: Scratch) -> DataFrame:
    """values (recording, channel, idx, value) with rank, from 0, ties in order of idx; a signal may span many tasks.

    Rows are dealt by range of value, numbered within their range, and ranges
    add up before them: what is joined back is a number for each range and signal.
    """
    ship(values.sparkSession)
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = values.select(*SIGNAL, "idx", "value").repartitionByRange(parts, *SIGNAL, "value", "idx").sortWithinPartitions(*SIGNAL, "value", "idx")

    def number(frames):
        from pyspark import TaskContext

        part, key, at = TaskContext.get().partitionId(), None, 0
        for f in frames:
            f = f.reset_index(drop=True)
            f["part"], f["rank"] = part, 0
            for k, g in f.groupby(SIGNAL, sort=False):
                if k != key:
                    key, at = k, 0
                f.loc[g.index, "rank"] = np.arange(at, at + len(g))
                at += len(g)
            yield f

    named = scratch.save(dealt.mapInPandas(number, "recording string, channel string, idx long, value double, part int, rank long"))
    counts = named.groupBy(*SIGNAL, "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*SIGNAL).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.save(counts.select(*SIGNAL, "part", F.coalesce(before, F.lit(0)).alias("before")))
    joined = named.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_SIGNALS else offsets, [*SIGNAL, "part"])
    return joined.select(*SIGNAL, "idx", "value", (F.col("rank") + F.col("before")).alias("rank"))


def iaaft(samples: DataFrame, seed: int = 0, most: int = 100, tol: float = 1e-8, row: int = ROW, start: DataFrame | None = None) -> DataFrame:
    """Surrogates with the values of the signals and nearly the amplitudes of their spectra; rows (recording, channel, idx, value).

    Each pass gives the amplitudes to the present phases, and the values to the
    ranks of what comes out. It ends when no rank or no signal's spectral error
    moves, or after `most` passes. start: rows to begin with, else the values in
    an order that follows from the seed. A signal whose length has no factors but
    one beyond `row` is one row here.
    """
    scratch = Scratch(samples.sparkSession, "iaaft")
    table = lengths(samples, scratch, row)
    tall = lambda s: s.select(*SIGNAL, "idx", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    goal = forward(tall(samples), table)
    goal = scratch.save(goal.select(*ROWS, F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"])).alias("amplitude")))
    values = scratch.save(ranked(samples, scratch).select(*SIGNAL, "rank", "value"))
    if start is None:
        drawn = samples.select(*SIGNAL, "idx", F.xxhash64(F.lit(seed), "idx").cast("double").alias("value"))
        start = ranked(drawn, scratch).select(*SIGNAL, "idx", "rank").join(values, [*SIGNAL, "rank"]).select(*SIGNAL, "idx", "value")
    now = scratch.save(start.select(*SIGNAL, "idx", "value"))
    order, error = None, None
    for _ in range(most):
        met = forward(tall(now), table).join(goal, ROWS)
        made = inverse(changed(met, lambda k, z, at: at["amplitude"] * np.exp(1j * np.angle(z))))
        placed = scratch.save(ranked(made.select(*SIGNAL, "idx", F.col("re").alias("value")), scratch).select(*SIGNAL, "idx", "rank"))
        after = scratch.save(placed.join(values, [*SIGNAL, "rank"]).select(*SIGNAL, "idx", "value"))
        scratch.drop(now)
        now = after
        met = forward(tall(now), table).join(goal, ROWS)
        off = F.aggregate(F.arrays_zip("re", "im", "amplitude"), F.lit(0.0), lambda s, z: s + F.pow(F.hypot(z["re"], z["im"]) - z["amplitude"], F.lit(2)))
        size = F.aggregate("amplitude", F.lit(0.0), lambda s, a: s + a * a)
        errors = {tuple(r[:2]): r["e"] for r in met.select(*SIGNAL, off.alias("off"), size.alias("size")).groupBy(*SIGNAL).agg(F.try_divide(F.sqrt(F.sum("off")), F.sqrt(F.sum("size"))).alias("e")).collect()}
        moved = order is None or placed.join(order, [*SIGNAL, "idx", "rank"], "left_anti").limit(1).count()
        if not moved or (error is not None and all(abs((error[k] or 0) - (e or 0)) < tol for k, e in errors.items())):
            break
        order, error = placed, errors
    return now
