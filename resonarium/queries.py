"""Registered queries of the signal operators: QUERIES by name, SQL where an oracle exists.

Every query runs over whole tables. Signals are hourly sums of events (24
samples a day, so frequencies are in cycles a day). Doubles are rounded to six
decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonarium.model import SignalSet
from resonarium.operators import align, directed, fusion, inference, lodo, pac, phase, plots, spectral, timedom, wavelet
from resonarium.plans import registry
from resonarium.sources import signals
from resonarium.streaming import sliding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SR, N, SEG = 24.0, 720, 64
BAND, AMP = (0.5, 2.0), (4.0, 8.0)


def query(sql: str | None = None):
    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(c.name, 6) + 0.0).alias(c.name) if isinstance(c.dataType, (T.DoubleType, T.FloatType)) else F.col(c.name) for c in df.schema.fields))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.event_grid(spark, sf_dir)


def rd(x: str) -> str:
    return f"ROUND({x}, 6) + 0.0"


def grid_sql(minutes: int = 60, name: str = "g") -> str:
    n = 30 * 1440 // minutes
    since = f"floor((date_diff('day', DATE '2024-01-01', ts::DATE) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts)) / {minutes})::BIGINT"
    return f"""{name}_e AS (SELECT event_type AS channel, {since} AS idx, value FROM events),
{name}_v AS (SELECT channel, idx, SUM(value) AS value FROM {name}_e WHERE idx BETWEEN 0 AND {n - 1} GROUP BY channel, idx),
{name} AS (SELECT c.channel, i.range AS idx, COALESCE(v.value, 0.0) AS value FROM (SELECT DISTINCT channel FROM {name}_v) c CROSS JOIN range({n}) i LEFT JOIN {name}_v v ON v.channel = c.channel AND v.idx = i.range)"""


G = grid_sql()
#: Half spectra of Hann-windowed segments of 64 with overlap 32.
SEGS = f"""{G},
s AS (SELECT g.channel, seg.range AS seg, g.idx - 32 * seg.range AS m, g.value * (0.5e0 * (1 - cos(2 * pi() * (g.idx - 32 * seg.range) / 63))) AS v FROM g JOIN range(21) seg ON g.idx >= 32 * seg.range AND g.idx < 32 * seg.range + 64),
f AS (SELECT channel, seg, b.range AS bin, SUM(v * cos(2 * pi() * b.range * m / 64)) AS re, -SUM(v * sin(2 * pi() * b.range * m / 64)) AS im FROM s CROSS JOIN range(33) b GROUP BY channel, seg, b.range),
p AS (SELECT x.channel AS channel_x, y.channel AS channel_y, x.bin, COUNT(*) AS n, AVG(x.re * y.re + x.im * y.im) AS re, AVG(x.im * y.re - x.re * y.im) AS im, AVG(x.re * x.re + x.im * x.im) AS xx, AVG(y.re * y.re + y.im * y.im) AS yy
  FROM f x JOIN f y ON x.seg = y.seg AND x.bin = y.bin AND x.channel < y.channel GROUP BY x.channel, y.channel, x.bin)"""
W2 = sum((0.5 * (1 - __import__("math").cos(2 * __import__("math").pi * m / 63))) ** 2 for m in range(64))
TWICE = "CASE WHEN bin IN (0, 32) THEN 1.0e0 ELSE 2.0e0 END"


def band_sql(name: str, lo: int, hi: int) -> str:
    """Analytic signal of an ideal band of bins lo..hi of the 720-point transform."""
    return f"""{name}_f AS (SELECT channel, k.range AS k, SUM(value * cos(2 * pi() * ((k.range * idx) % 720) / 720)) AS a, -SUM(value * sin(2 * pi() * ((k.range * idx) % 720) / 720)) AS b FROM g CROSS JOIN range({lo}, {hi + 1}) k GROUP BY channel, k.range),
{name} AS (SELECT channel, i.range AS idx, SUM(a * cos(2 * pi() * ((k * i.range) % 720) / 720) - b * sin(2 * pi() * ((k * i.range) % 720) / 720)) / 360 AS re, SUM(a * sin(2 * pi() * ((k * i.range) % 720) / 720) + b * cos(2 * pi() * ((k * i.range) % 720) / 720)) / 360 AS im FROM {name}_f CROSS JOIN range(720) i GROUP BY channel, i.range)"""


ZP = f"""{G}, {band_sql('z', 15, 60)},
q AS (SELECT x.channel AS channel_x, y.channel AS channel_y, x.idx, x.re AS ax, x.im AS bx, y.re AS ay, y.im AS by_, x.re * y.re + x.im * y.im AS c, x.im * y.re - x.re * y.im AS s FROM z x JOIN z y ON x.idx = y.idx AND x.channel < y.channel),
u AS (SELECT *, sqrt(c * c + s * s) AS r FROM q),
m AS (SELECT channel_x, channel_y, COUNT(*) AS n, AVG(c / r) AS mc, AVG(s / r) AS ms, AVG(sign(s)) AS sg, SUM(s) AS si, SUM(abs(s)) AS sa, SUM(s * s) AS sq FROM u GROUP BY channel_x, channel_y)"""


# ---- the table layer -------------------------------------------------------


def two_rates(spark: SparkSession, sf_dir: str) -> SignalSet:
    rows = hourly(spark, sf_dir).withColumn("recording", F.lit("hourly")).unionByName(signals.event_grid(spark, sf_dir, 30).withColumn("recording", F.lit("half")))
    return SignalSet.of(rows, {"hourly": 24.0, "half": 48.0})


@query(f"WITH {G}, {grid_sql(30, 'h')} SELECT modality, {rd('sr')} AS sr, {rd('CAST(0 AS DOUBLE)')} AS \"offset\", n_channels FROM (SELECT 'hourly' AS modality, 24.0e0 AS sr, COUNT(DISTINCT channel) AS n_channels FROM g UNION ALL SELECT 'half', 48.0e0, COUNT(DISTINCT channel) FROM h)")
def modality_counts(spark, sf_dir):
    s = two_rates(spark, sf_dir)
    return s.alignment.join(s.channels.groupBy("modality").agg(F.count("*").alias("n_channels")), "modality")


@query(f"WITH {G}, {grid_sql(30, 'h')} SELECT 'hourly' AS modality, channel, idx - 24 AS idx, {rd('value')} AS value FROM g WHERE idx BETWEEN 24 AND 72 UNION ALL SELECT 'half', channel, idx - 48, {rd('value')} FROM h WHERE idx BETWEEN 48 AND 144")
def slice_time_range(spark, sf_dir):
    return two_rates(spark, sf_dir).slice(["hourly", "half"], 1.0, 3.0).samples


@query(f"WITH {G}, {grid_sql(30, 'h')} SELECT 'x_' || channel AS channel, COUNT(*) AS n, {rd('SUM(value)')} AS total FROM g GROUP BY channel UNION ALL SELECT 'y_' || channel, COUNT(*), {rd('SUM(value)')} FROM h GROUP BY channel")
def merge_channels(spark, sf_dir):
    both = align.merge(hourly(spark, sf_dir), signals.event_grid(spark, sf_dir, 30))
    return both.groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {G}, t AS (SELECT j.range AS j, j.range * 719.0e0 / 499 AS u FROM range(500) j), k AS (SELECT j, LEAST(floor(u), 718)::BIGINT AS k, u - LEAST(floor(u), 718) AS w FROM t)
SELECT a.channel, k.j AS idx, {rd('a.value * (1 - k.w) + b.value * k.w')} AS value FROM k JOIN g a ON a.idx = k.k JOIN g b ON b.idx = k.k + 1 AND b.channel = a.channel""")
def resample_linear(spark, sf_dir):
    return align.resample_linear(hourly(spark, sf_dir), F.lit(500).cast("long"), ["channel"])


@query(f"""WITH {G}, d AS (SELECT *, (lead(value) OVER w - value) * 719 AS d0, (value - lag(value) OVER w) * 719 AS d1 FROM g WINDOW w AS (PARTITION BY channel ORDER BY idx))
SELECT channel, idx, {rd('sign(COALESCE(d0, d1)) * sqrt(abs(COALESCE(d0, d1)))')} AS q FROM d""")
def srvf_transform(spark, sf_dir):
    return align.srvf_rows(hourly(spark, sf_dir), ["channel"]).select("channel", "idx", "q")


@query()
def align_rates(spark, sf_dir):
    """Half-hourly channels brought to the hourly rate through the low-pass filter."""
    return align.align(two_rates(spark, sf_dir), "lowest_rate").samples


@query()
def align_spline(spark, sf_dir):
    return align.align(two_rates(spark, sf_dir), "common_rate", resampling="spline").samples


@query()
def align_fft(spark, sf_dir):
    return align.align(two_rates(spark, sf_dir), "resample", 36.0, resampling="fft").samples


@query()
def elastic_align(spark, sf_dir):
    """Daily profiles of every channel against those of clicks."""
    daily = hourly(spark, sf_dir).groupBy("channel", (F.col("idx") % 24).alias("hour")).agg(F.avg("value").alias("v"))
    curves = daily.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("hour", "v"))).alias("c")).select("channel", F.col("c.v").alias("y"))
    ref = curves.where("channel = 'click'").select(F.col("y").alias("x"))
    return align.elastic_align(curves.crossJoin(F.broadcast(ref)).select("channel", "x", "y")).select("channel", "amplitude_distance", "phase_distance", F.size("gamma").alias("n"))


@query()
def srvf_mean(spark, sf_dir):
    daily = hourly(spark, sf_dir).groupBy("channel", (F.col("idx") % 24).alias("hour")).agg(F.avg("value").alias("v"))
    curves = daily.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("hour", "v"))).alias("c")).select(F.col("channel").alias("curve"), F.col("c.v").alias("y"))
    return align.srvf_mean(curves)[1].select("curve", F.size("aligned").alias("n"))


# ---- spectra ---------------------------------------------------------------


@query(f"WITH {SEGS} SELECT channel, bin::INT AS bin, {rd('bin * 12.0e0 / 32')} AS frequency, {rd(f'AVG(re * re + im * im) * {TWICE} / ({SR} * {W2!r}::DOUBLE)')} AS psd FROM f GROUP BY channel, bin")
def welch_psd(spark, sf_dir):
    return spectral.welch_psd(hourly(spark, sf_dir), SR, SEG).drop("recording")


@query(f"""WITH {SEGS}, c AS (SELECT channel_x, channel_y, bin, re * {TWICE} / ({SR} * {W2!r}::DOUBLE) AS re, im * {TWICE} / ({SR} * {W2!r}::DOUBLE) AS im FROM p)
SELECT channel_x, channel_y, bin::INT AS bin, {rd('bin * 12.0e0 / 32')} AS frequency, {rd('re')} AS re, {rd('im')} AS im, {rd('sqrt(re * re + im * im)')} AS magnitude FROM c""")
def cross_spectrum(spark, sf_dir):
    return spectral.cross_spectrum(hourly(spark, sf_dir), SR, SEG).drop("recording", "phase")


def _coherence_sql(value: str) -> str:
    return f"WITH {SEGS}, c AS (SELECT channel_x, channel_y, bin, n, re / sqrt(xx * yy) AS re, im / sqrt(xx * yy) AS im FROM p) SELECT channel_x, channel_y, bin::INT AS bin, {rd('bin * 12.0e0 / 32')} AS frequency, {rd(value)} AS coherence, {rd('1 - pow(0.05e0, 1.0e0 / (n - 1))')} AS confidence FROM c"


@query(_coherence_sql("LEAST(1.0e0, re * re + im * im)"))
def coherence_magnitude(spark, sf_dir):
    return spectral.coherence(hourly(spark, sf_dir), SR, SEG).drop("recording")


@query(_coherence_sql("im"))
def coherence_imaginary(spark, sf_dir):
    return spectral.coherence(hourly(spark, sf_dir), SR, SEG, kind="imaginary").drop("recording")


@query(_coherence_sql("im / sqrt(GREATEST(1 - re * re, 2.220446049250313e-16))"))
def coherence_lagged(spark, sf_dir):
    return spectral.lagged_coherence(hourly(spark, sf_dir), SR, nperseg=SEG).drop("recording")


@query(f"WITH {SEGS} SELECT channel_x, channel_y, {rd('MAX(LEAST(1.0e0, (re * re + im * im) / (xx * yy)))')} AS peak FROM p GROUP BY channel_x, channel_y")
def coherence_matrix(spark, sf_dir):
    return spectral.coherence_matrix(hourly(spark, sf_dir), SR, SEG).select("channel_x", "channel_y", "peak")


@query(f"""WITH {SEGS}, c AS (SELECT channel_x, channel_y, bin, (re * re + im * im) / (xx * yy) AS coherence FROM p), k AS (SELECT channel_x, channel_y, MAX(coherence) AS peak, arg_max(bin, coherence) AS best FROM c GROUP BY channel_x, channel_y)
SELECT channel_x, channel_y, {rd('peak')} AS peak, {rd('best * 24 / 64.0e0')} AS peak_frequency, bin::INT AS bin, {rd('bin * 24 / 64.0e0')} AS frequency, {rd('coherence')} AS coherence, {rd('1 - pow(0.05e0, 1 / 20.0e0)')} AS confidence FROM c JOIN k USING (channel_x, channel_y)""")
def coherence_matrix_spectra(spark, sf_dir):
    rows = spectral.coherence_spectra(hourly(spark, sf_dir), SR, SEG)
    return rows.select("channel_x", "channel_y", "peak", "peak_frequency", F.inline("spectrum"))


@query(f"""WITH {SEGS}, c AS (SELECT channel_x, channel_y, bin, re / sqrt(xx * yy) AS re, im / sqrt(xx * yy) AS im FROM p WHERE bin * 12.0e0 / 32 BETWEEN 1 AND 4),
l AS (SELECT *, lead(re) OVER w AS re2, lead(im) OVER w AS im2 FROM c WINDOW w AS (PARTITION BY channel_x, channel_y ORDER BY bin))
SELECT channel_x, channel_y, {rd('SUM(re * im2 - im * re2) / SUM(sqrt(re * re + im * im) * sqrt(re2 * re2 + im2 * im2))')} AS psi FROM l WHERE re2 IS NOT NULL GROUP BY channel_x, channel_y""")
def phase_slope_index(spark, sf_dir):
    return spectral.phase_slope_index(hourly(spark, sf_dir), SR, (1, 4), SEG).drop("recording")


@query()
def multitaper_psd(spark, sf_dir):
    return spectral.multitaper_psd(hourly(spark, sf_dir), SR).select("channel", F.size("psd").alias("bins"), F.aggregate("psd", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query()
def multitaper_coherence(spark, sf_dir):
    return spectral.multitaper_coherence(hourly(spark, sf_dir), SR).drop("recording")


# ---- time domain -----------------------------------------------------------

CCF = f"""{G}, mu AS (SELECT channel, AVG(value) AS m FROM g GROUP BY channel), d AS (SELECT g.channel, g.idx, g.value - mu.m AS d FROM g JOIN mu USING (channel)),
c0 AS (SELECT channel, SUM(d * d) AS v FROM d GROUP BY channel),
cc AS (SELECT x.channel AS channel_x, y.channel AS channel_y, l.range - 30 AS lag, SUM(x.d * y.d) AS v FROM d y CROSS JOIN range(61) l JOIN d x ON x.idx = y.idx + l.range - 30 AND x.channel < y.channel GROUP BY 1, 2, 3),
r AS (SELECT cc.channel_x, cc.channel_y, cc.lag, cc.v / sqrt(a.v * b.v) AS correlation FROM cc JOIN c0 a ON a.channel = cc.channel_x JOIN c0 b ON b.channel = cc.channel_y)"""


@query(f"WITH {CCF} SELECT channel_x, channel_y, lag::INT AS lag, {rd('lag / 24.0e0')} AS lag_sec, {rd('correlation')} AS correlation FROM r")
def cross_correlation(spark, sf_dir):
    return timedom.cross_correlation(hourly(spark, sf_dir), SR, 30).drop("recording")


@query(f"WITH {CCF} SELECT channel_x, channel_y, arg_max(lag, abs(correlation))::INT AS peak_lag, {rd('arg_max(correlation, abs(correlation))')} AS peak FROM r GROUP BY channel_x, channel_y")
def cross_correlation_peak(spark, sf_dir):
    return timedom.correlation_peak(timedom.cross_correlation(hourly(spark, sf_dir), SR, 30)).drop("recording", "peak_lag_sec")


SLIDE = f"""{G}, w AS (SELECT g.channel, w.range AS win, g.idx - 48 * w.range AS m, g.value FROM g JOIN range(13) w ON g.idx >= 48 * w.range AND g.idx < 48 * w.range + 120),
d AS (SELECT channel, win, m, value - AVG(value) OVER (PARTITION BY channel, win) AS d FROM w),
c0 AS (SELECT channel, win, SUM(d * d) AS v FROM d GROUP BY channel, win),
cc AS (SELECT x.channel AS channel_x, y.channel AS channel_y, x.win, l.range - 6 AS lag, SUM(x.d * y.d) AS v FROM d y CROSS JOIN range(13) l JOIN d x ON x.win = y.win AND x.m = y.m + l.range - 6 AND x.channel < y.channel GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {SLIDE} SELECT channel_x, channel_y, cc.win, {rd('(cc.win * 48 + 59.5e0) / 24')} AS time, cc.lag::INT AS lag, {rd('cc.v / sqrt(a.v * b.v)')} AS correlation FROM cc JOIN c0 a ON a.channel = channel_x AND a.win = cc.win JOIN c0 b ON b.channel = channel_y AND b.win = cc.win")
def sliding_cross_correlation(spark, sf_dir):
    return timedom.sliding_cross_correlation(hourly(spark, sf_dir), SR, 5, 2, 6).drop("recording", "lag_sec")


@query(f"WITH {SLIDE}, r AS (SELECT channel_x, channel_y, cc.win, cc.lag, cc.v / sqrt(a.v * b.v) AS c FROM cc JOIN c0 a ON a.channel = channel_x AND a.win = cc.win JOIN c0 b ON b.channel = channel_y AND b.win = cc.win) SELECT channel_x || '-' || channel_y AS pair, {rd('(win * 48 + 59.5e0) / 24')} AS time, {rd('arg_max(c, abs(c))')} AS peak FROM r GROUP BY channel_x, channel_y, win")
def coupling_timecourse_frame(spark, sf_dir):
    return plots.coupling_timecourse_frame(timedom.sliding_cross_correlation(hourly(spark, sf_dir), SR, 5, 2, 6))


@query(f"""WITH {G}, d AS (SELECT channel, idx, value - AVG(value) OVER (PARTITION BY channel) AS d FROM g), l AS (SELECT channel, d, lag(d) OVER (PARTITION BY channel ORDER BY idx) AS p FROM d)
SELECT channel, {rd('LEAST(0.999e0, GREATEST(0.0e0, SUM(d * p) / SUM(d * d)))')} AS acf1 FROM l GROUP BY channel""")
def acf_lag1(spark, sf_dir):
    return timedom.lag1(hourly(spark, sf_dir)).drop("recording")


@query("SELECT i.range AS idx, " + rd("sqrt(2.0e0) * 7 / (2 * pi() * GREATEST(LEAST(i.range, 719 - i.range) / 24.0e0, 1 / 24.0e0))") + " AS coi FROM range(720) i")
def cone_of_influence(spark, sf_dir):
    return spark.range(N).select(F.col("id").alias("idx"), wavelet.coi(F.col("id"), F.lit(N), SR).alias("coi"))


# ---- phase -----------------------------------------------------------------


def _synchrony(spark, sf_dir, *names):
    return phase.synchrony(hourly(spark, sf_dir), SR, BAND, kind="fft").select("channel_x", "channel_y", *names)


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('sqrt(mc * mc + ms * ms)')} AS plv FROM m")
def plv(spark, sf_dir):
    return _synchrony(spark, sf_dir, "plv")


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('abs(sg)')} AS pli FROM m")
def pli(spark, sf_dir):
    return _synchrony(spark, sf_dir, "pli")


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('abs(si) / sa')} AS wpli FROM m")
def wpli(spark, sf_dir):
    return _synchrony(spark, sf_dir, "wpli")


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('(si * si - sq) / (sa * sa - sq)')} AS wpli_debiased FROM m")
def wpli_debiased(spark, sf_dir):
    return _synchrony(spark, sf_dir, "wpli_debiased")


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('abs(ms / sqrt(1 - mc * mc))')} AS ciplv FROM m")
def ciplv(spark, sf_dir):
    return _synchrony(spark, sf_dir, "ciplv")


@query(f"WITH {ZP} SELECT channel_x, channel_y, {rd('((mc * mc + ms * ms) * n * n - n) / (n * (n - 1.0e0))')} AS ppc FROM m")
def ppc(spark, sf_dir):
    return _synchrony(spark, sf_dir, "ppc")


@query(f"""WITH {ZP}, e AS (SELECT channel_x, channel_y, sqrt(ax * ax + bx * bx) AS ex, sqrt(ay * ay + by_ * by_) AS ey,
  sqrt(pow(ay - c * ax / (ax * ax + bx * bx + 2.220446049250313e-16), 2) + pow(by_ - c * bx / (ax * ax + bx * bx + 2.220446049250313e-16), 2)) AS fy,
  sqrt(pow(ax - c * ay / (ay * ay + by_ * by_ + 2.220446049250313e-16), 2) + pow(bx - c * by_ / (ay * ay + by_ * by_ + 2.220446049250313e-16), 2)) AS fx FROM q)
SELECT channel_x, channel_y, {rd('(corr(ex, fy) + corr(ey, fx)) / 2')} AS aec FROM e GROUP BY channel_x, channel_y""")
def aec_orth(spark, sf_dir):
    return _synchrony(spark, sf_dir, "aec")


@query(f"WITH {ZP} SELECT channel_x, channel_y, idx::INT AS idx, {rd('cos(atan2(s, c))')} AS c, {rd('sin(atan2(s, c))')} AS s FROM q")
def phase_difference(spark, sf_dir):
    d = phase.phase_difference(hourly(spark, sf_dir), SR, BAND, kind="fft")
    return d.select("channel_x", "channel_y", "idx", F.cos("difference").alias("c"), F.sin("difference").alias("s"))


LEIDA = f"""{G}, {band_sql('z', 15, 60)}, a AS (SELECT channel, idx, re / sqrt(re * re + im * im) AS c, im / sqrt(re * re + im * im) AS s FROM z),
t AS (SELECT *, 0.5e0 * atan2(2 * SUM(c * s) OVER w, SUM(c * c - s * s) OVER w) AS t FROM a WINDOW w AS (PARTITION BY idx)),
v AS (SELECT channel, idx, c * cos(t) + s * sin(t) AS u FROM t), n AS (SELECT *, u / sqrt(SUM(u * u) OVER (PARTITION BY idx)) AS un, SUM(sign(u)) OVER (PARTITION BY idx) AS bal FROM v)"""


@query(f"WITH {LEIDA} SELECT idx::INT AS idx, channel, {rd('CASE WHEN bal < 0 THEN -un ELSE un END')} AS v FROM n")
def leida_vectors(spark, sf_dir):
    return phase.leida_vectors(hourly(spark, sf_dir), SR, BAND, kind="fft").drop("recording")


def _states(spark, sf_dir):
    """States by level of each channel: a deterministic sequence for the state metrics."""
    return hourly(spark, sf_dir).select("channel", "idx", F.when(F.col("value") < 100, 1).when(F.col("value") < 250, 2).otherwise(3).alias("state"))


STATES = f"{G}, st AS (SELECT channel, idx, CASE WHEN value < 100 THEN 1 WHEN value < 250 THEN 2 ELSE 3 END AS state FROM g), nx AS (SELECT channel, idx, state, lead(state) OVER (PARTITION BY channel ORDER BY idx) AS nxt FROM st), tr AS (SELECT channel, state, nxt, COUNT(*) AS n FROM nx WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), tp AS (SELECT *, n / SUM(n) OVER (PARTITION BY channel, state)::DOUBLE AS p FROM tr)"


@query(f"WITH {STATES} SELECT channel, state AS state_from, nxt AS state_to, n, {rd('p')} AS p FROM tp")
def leida_transitions(spark, sf_dir):
    return phase.leida_transitions(_states(spark, sf_dir), ["channel"])


@query(f"""WITH {STATES}, h AS (SELECT channel, state, -SUM(p * log2(p)) AS h FROM tp GROUP BY 1, 2), o AS (SELECT channel, state, COUNT(*) / 720.0e0 AS o FROM st GROUP BY 1, 2),
e AS (SELECT o.channel, SUM(o.o * COALESCE(h.h, 0)) AS entropy FROM o LEFT JOIN h ON h.channel = o.channel AND h.state = o.state GROUP BY 1), s AS (SELECT channel, AVG((state <> nxt)::INT) AS r FROM nx WHERE nxt IS NOT NULL GROUP BY 1)
SELECT s.channel, {rd('s.r')} AS switching_rate, {rd('s.r * 24')} AS switching_hz, {rd('e.entropy')} AS entropy FROM s JOIN e USING (channel)""")
def leida_summary(spark, sf_dir):
    return phase.leida_summary(_states(spark, sf_dir), SR, ["channel"])


@query(f"""WITH {STATES}, r AS (SELECT channel, state, row_number() OVER (PARTITION BY channel ORDER BY idx) - row_number() OVER (PARTITION BY channel, state ORDER BY idx) AS g FROM st), l AS (SELECT channel, state, g, COUNT(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT channel, state, {rd('SUM(n) / 720.0e0')} AS occupancy, {rd('AVG(n) / 24')} AS mean_dwell, COUNT(*) AS n_visits FROM l GROUP BY channel, state""")
def leida_dwell(spark, sf_dir):
    return phase.leida_dwell(_states(spark, sf_dir), SR, ["channel"])


@query()
def leida_states(spark, sf_dir):
    return phase.leida_states(hourly(spark, sf_dir), SR, BAND, kind="fft").groupBy("state").agg(F.count("*").alias("n"))


# ---- phase-amplitude coupling ----------------------------------------------


def _xy(spark, sf_dir):
    g = hourly(spark, sf_dir)
    return g.where("channel = 'click'"), g.where("channel = 'view'")


PAC = f"{G}, {band_sql('zp', 15, 45)}, {band_sql('za', 120, 240)}, pa AS (SELECT p.idx, atan2(p.im, p.re) AS ph, sqrt(a.re * a.re + a.im * a.im) AS amp FROM zp p JOIN za a ON a.idx = p.idx WHERE p.channel = 'click' AND a.channel = 'view')"
BINS = "tb AS (SELECT LEAST(17, GREATEST(0, ceil((ph + pi()) / (2 * pi() / 18)) - 1))::INT AS bin, AVG(amp) AS m FROM pa GROUP BY 1), tot AS (SELECT SUM(m) AS t FROM tb)"


def _pac(spark, sf_dir, method):
    return pac.phase_amplitude_coupling(*_xy(spark, sf_dir), SR, (0.5, 1.5), AMP, method, kind="fft")


@query(f"WITH {PAC}, {BINS} SELECT {rd('(ln(18) + SUM((m / t) * ln(m / t))) / ln(18)')} AS pac FROM tb, tot")
def pac_tort(spark, sf_dir):
    return _pac(spark, sf_dir, "tort")


@query(f"WITH {PAC}, {BINS} SELECT bin, {rd('m / t')} AS share FROM tb, tot")
def pac_distribution(spark, sf_dir):
    x, y = _xy(spark, sf_dir)
    from resonarium.operators.packed import pack

    one = lambda df: pack(df.select(F.lit(0).alias("k"), "idx", "value"), ["k"])
    ph = pac.bank(one(x), [(1.0, 0.5, 1.5)], SR, "phase", kind="fft", keep=["k"]).select("idx", F.col("v").alias("phase"))
    am = pac.bank(one(y), [(6.0, *AMP)], SR, "envelope", kind="fft", keep=["k"]).select("k", "idx", F.col("v").alias("amp"))
    return pac.distribution(ph.join(am, "idx"), ["k"]).select("bin", "share")


@query(f"WITH {PAC} SELECT {rd('sqrt(pow(AVG(amp * cos(ph)), 2) + pow(AVG(amp * sin(ph)), 2))')} AS pac FROM pa")
def pac_canolty(spark, sf_dir):
    return _pac(spark, sf_dir, "canolty")


@query(f"WITH {PAC} SELECT {rd('sqrt(pow(SUM(amp * cos(ph)), 2) + pow(SUM(amp * sin(ph)), 2)) / (sqrt(COUNT(*)) * sqrt(SUM(amp * amp)))')} AS pac FROM pa")
def pac_ozkurt(spark, sf_dir):
    return _pac(spark, sf_dir, "ozkurt")


@query(f"""WITH {PAC}, ec AS (SELECT 'e' AS channel, idx, amp AS value FROM pa), {band_sql('ze', 15, 45).replace('FROM g ', 'FROM ec ')}, pd AS (SELECT ph - atan2(e.im, e.re) AS d FROM pa JOIN ze e ON e.idx = pa.idx)
SELECT {rd('sqrt(pow(AVG(cos(d)), 2) + pow(AVG(sin(d)), 2))')} AS pac FROM pd""")
def pac_plv(spark, sf_dir):
    return _pac(spark, sf_dir, "plv")


COMO = f"{G}, {band_sql('p1', 15, 45)}, {band_sql('p2', 45, 75)}, {band_sql('a1', 105, 195)}, {band_sql('a2', 195, 285)}, ph AS (SELECT 1.0e0 AS phase_freq, * FROM p1 UNION ALL SELECT 2.0e0, * FROM p2), am AS (SELECT 5.0e0 AS amp_freq, * FROM a1 UNION ALL SELECT 8.0e0, * FROM a2), cells AS (SELECT phase_freq, amp_freq, sqrt(pow(AVG(sqrt(a.re * a.re + a.im * a.im) * cos(atan2(p.im, p.re))), 2) + pow(AVG(sqrt(a.re * a.re + a.im * a.im) * sin(atan2(p.im, p.re))), 2)) AS pac FROM ph p JOIN am a ON a.idx = p.idx WHERE p.channel = 'click' AND a.channel = 'view' GROUP BY 1, 2)"


def _como(spark, sf_dir):
    return pac.comodulogram(*_xy(spark, sf_dir), SR, [1, 2], [5, 8], 1, 3, "canolty", kind="fft")


@query(f"WITH {COMO} SELECT {rd('phase_freq')} AS phase_freq, {rd('amp_freq')} AS amp_freq, {rd('pac')} AS pac FROM cells")
def comodulogram(spark, sf_dir):
    return _como(spark, sf_dir)


@query(f"WITH {COMO} SELECT {rd('phase_freq')} AS phase_freq, {rd('amp_freq')} AS amp_freq, {rd('pac')} AS pac FROM cells ORDER BY cells.pac DESC LIMIT 1")
def comodulogram_peak(spark, sf_dir):
    return pac.peak(_como(spark, sf_dir))


@query()
def modulation_index(spark, sf_dir):
    return pac.modulation_index(*_xy(spark, sf_dir), SR, [1, 2], [5, 8], 1, 3, n_surrogates=99, kind="fft")


# ---- directed coupling -----------------------------------------------------


@query(f"WITH {G}, d AS (SELECT channel, idx, value - AVG(value) OVER (PARTITION BY channel) AS d FROM g), l AS (SELECT channel, idx, d AS h0, lag(d) OVER w AS h1, lag(d, 2) OVER w AS h2 FROM d WINDOW w AS (PARTITION BY channel ORDER BY idx)) SELECT channel, idx, {rd('h0')} AS h0, {rd('h1')} AS h1, {rd('h2')} AS h2 FROM l WHERE h2 IS NOT NULL")
def ar_lag_features(spark, sf_dir):
    rows = directed.lag_features(hourly(spark, sf_dir), 2)
    return rows.select("channel", "idx", *(F.get("h", F.lit(k)).alias(f"h{k}") for k in range(3)))


@query(f"""WITH {G}, d AS (SELECT channel, idx, value - AVG(value) OVER (PARTITION BY channel) AS d FROM g), l AS (SELECT channel, idx, d AS y, lag(d) OVER (PARTITION BY channel ORDER BY idx) AS y1 FROM d),
j AS (SELECT a.channel AS ch_d, b.channel AS ch_t, b.y, b.y1, a.y1 AS x1 FROM l a JOIN l b ON a.idx = b.idx AND a.channel <> b.channel WHERE a.y1 IS NOT NULL),
m AS (SELECT ch_d, ch_t, COUNT(*) AS n, SUM(y * y) AS yy, SUM(y1 * y1) AS aa, SUM(x1 * x1) AS bb, SUM(y1 * x1) AS ab, SUM(y * y1) AS ya, SUM(y * x1) AS yb FROM j GROUP BY 1, 2),
k AS (SELECT *, aa + 1e-8 * aa AS ar, aa + 1e-8 * GREATEST(aa, bb) AS af, bb + 1e-8 * GREATEST(aa, bb) AS bf FROM m),
c AS (SELECT *, ya / ar AS b0, (ya * bf - yb * ab) / (af * bf - ab * ab) AS b1, (yb * af - ya * ab) / (af * bf - ab * ab) AS b2 FROM k),
e AS (SELECT ch_d, ch_t, GREATEST(0.0e0, ln((yy - 2 * b0 * ya + b0 * b0 * aa) / (yy - 2 * b1 * ya - 2 * b2 * yb + b1 * b1 * aa + 2 * b1 * b2 * ab + b2 * b2 * bb))) AS gc FROM c)
SELECT x.ch_d AS channel_x, x.ch_t AS channel_y, {rd('x.gc')} AS gc_xy, {rd('y.gc')} AS gc_yx FROM e x JOIN e y ON y.ch_d = x.ch_t AND y.ch_t = x.ch_d WHERE x.ch_d < x.ch_t""")
def granger_order1(spark, sf_dir):
    return directed.granger_causality(hourly(spark, sf_dir), SR, 1).select("channel_x", "channel_y", "gc_xy", "gc_yx")


@query()
def granger_order5(spark, sf_dir):
    return directed.granger_causality(hourly(spark, sf_dir), SR, 5).drop("recording")


@query()
def granger_spectral(spark, sf_dir):
    return directed.granger_causality(hourly(spark, sf_dir), SR, 5, (1, 4)).drop("recording")


#: Segments of 64 of signals at unit power, each about its mean, through a Hann window.
UNIT = f"""{G}, c AS (SELECT channel, idx, value - AVG(value) OVER (PARTITION BY channel) AS v FROM g), n AS (SELECT channel, idx, v / sqrt(AVG(v * v) OVER (PARTITION BY channel)) AS v FROM c),
s AS (SELECT channel, seg.range AS seg, idx - 32 * seg.range AS m, v FROM n JOIN range(21) seg ON idx >= 32 * seg.range AND idx < 32 * seg.range + 64),
t AS (SELECT channel, seg, m, (v - AVG(v) OVER (PARTITION BY channel, seg)) * (0.5e0 * (1 - cos(2 * pi() * m / 63))) AS v FROM s),
f AS (SELECT channel, seg, b.range AS bin, SUM(v * cos(2 * pi() * b.range * m / 64)) AS re, -SUM(v * sin(2 * pi() * b.range * m / 64)) AS im FROM t CROSS JOIN range(33) b GROUP BY channel, seg, b.range)"""


@query(f"""WITH {UNIT} SELECT x.channel AS channel_x, y.channel AS channel_y, x.bin, {rd(f'AVG(x.re * y.re + x.im * y.im) / (24 * {W2!r}) * CASE WHEN x.bin IN (0, 32) THEN 1 ELSE 2 END')} AS re, {rd(f'AVG(x.im * y.re - x.re * y.im) / (24 * {W2!r}) * CASE WHEN x.bin IN (0, 32) THEN 1 ELSE 2 END')} AS im
FROM f x JOIN f y ON x.seg = y.seg AND x.bin = y.bin GROUP BY x.channel, y.channel, x.bin""")
def granger_cross_spectra(spark, sf_dir):
    """The matrices that non-parametric causality factorizes, by Hann segments."""
    s = directed.cross_spectra(hourly(spark, sf_dir), SR, estimator="welch", segment_length=64)
    c = F.size("channels")
    rows = s.select("channels", c.alias("c"), F.posexplode(F.arrays_zip("re", "im")).alias("at", "z"))
    name = lambda k: F.get("channels", k.cast("int"))
    return rows.select(name(F.floor(F.col("at") / F.col("c")) % F.col("c")).alias("channel_x"), name(F.col("at") % F.col("c")).alias("channel_y"), F.floor(F.col("at") / (F.col("c") * F.col("c"))).alias("bin"), "z.re", "z.im")


@query()
def granger_spectra(spark, sf_dir):
    """Every bin of every pair, with what tells how well the factor fits."""
    rows = directed.granger_spectra(hourly(spark, sf_dir), SR)
    z = F.posexplode(F.arrays_zip("frequencies", "spectrum_xy", "spectrum_yx")).alias("bin", "z")
    return rows.select("channel_x", "channel_y", "status", "iterations", "reconstruction_error", z).select("channel_x", "channel_y", "status", "iterations", "reconstruction_error", "bin", F.col("z.frequencies").alias("frequency"), "z.spectrum_xy", "z.spectrum_yx")


@query()
def granger_nonparametric(spark, sf_dir):
    return directed.granger_causality(hourly(spark, sf_dir), SR, method="nonparametric").drop("recording")


#: Two channels with one lag: b11 .. b22 their coefficients, v1 and v2 their residual squares, at 128 frequencies (cosine c).
ORDER1 = f"""{G}, d AS (SELECT channel, idx, value - AVG(value) OVER (PARTITION BY channel) AS d FROM g WHERE channel IN ('click', 'view')),
z AS (SELECT x.d AS x, y.d AS y, lag(x.d) OVER (ORDER BY x.idx) AS p, lag(y.d) OVER (ORDER BY x.idx) AS q FROM d x JOIN d y ON x.idx = y.idx WHERE x.channel = 'click' AND y.channel = 'view'),
m AS (SELECT SUM(p * p) AS pp, SUM(p * q) AS pq, SUM(q * q) AS qq, SUM(x * p) AS xp, SUM(x * q) AS xq, SUM(y * p) AS yp, SUM(y * q) AS yq, SUM(x * x) AS xx, SUM(y * y) AS yy FROM z WHERE p IS NOT NULL),
b AS (SELECT (xp * qq - xq * pq) / (pp * qq - pq * pq) AS b11, (xq * pp - xp * pq) / (pp * qq - pq * pq) AS b12, (yp * qq - yq * pq) / (pp * qq - pq * pq) AS b21, (yq * pp - yp * pq) / (pp * qq - pq * pq) AS b22, m.* FROM m),
w AS (SELECT b11, b12, b21, b22, xx - b11 * xp - b12 * xq AS v1, yy - b21 * yp - b22 * yq AS v2, cos(2 * pi() * (i.range * 12.0e0 / 127) / 24) AS c FROM b CROSS JOIN range(128) i),
a AS (SELECT *, 1 - 2 * b11 * c + b11 * b11 AS a11, b12 * b12 AS a12, b21 * b21 AS a21, 1 - 2 * b22 * c + b22 * b22 AS a22 FROM w)"""


def _two(spark, sf_dir):
    return hourly(spark, sf_dir).where(F.col("channel").isin("click", "view"))


@query(f"""WITH {ORDER1}, r AS (SELECT AVG(sqrt(a22 / (a22 + a12))) AS h11, AVG(sqrt(a12 / (a22 + a12))) AS h12, AVG(sqrt(a21 / (a11 + a21))) AS h21, AVG(sqrt(a11 / (a11 + a21))) AS h22 FROM a)
SELECT 'click' AS target, 'click' AS source, {rd('h11')} AS value FROM r UNION ALL SELECT 'click', 'view', {rd('h12')} FROM r UNION ALL SELECT 'view', 'click', {rd('h21')} FROM r UNION ALL SELECT 'view', 'view', {rd('h22')} FROM r""")
def dtf_order1(spark, sf_dir):
    return directed.directed_transfer_function(_two(spark, sf_dir), SR, 1).select("target", "source", "value")


@query(f"""WITH {ORDER1}, r AS (SELECT AVG(sqrt(a11 / v1 / (a11 / v1 + a21 / v2))) AS p11, AVG(sqrt(a12 / v1 / (a12 / v1 + a22 / v2))) AS p12, AVG(sqrt(a21 / v2 / (a11 / v1 + a21 / v2))) AS p21, AVG(sqrt(a22 / v2 / (a12 / v1 + a22 / v2))) AS p22 FROM a)
SELECT 'click' AS target, 'click' AS source, {rd('p11')} AS value FROM r UNION ALL SELECT 'click', 'view', {rd('p12')} FROM r UNION ALL SELECT 'view', 'click', {rd('p21')} FROM r UNION ALL SELECT 'view', 'view', {rd('p22')} FROM r""")
def gpdc_order1(spark, sf_dir):
    return directed.partial_directed_coherence(_two(spark, sf_dir), SR, 1).select("target", "source", "value")


@query()
def dtf(spark, sf_dir):
    return directed.directed_transfer_function(hourly(spark, sf_dir), SR).drop("recording")


@query()
def gpdc(spark, sf_dir):
    return directed.partial_directed_coherence(hourly(spark, sf_dir), SR).drop("recording")


@query(f"""WITH {G}, r AS (SELECT channel, idx, value, lead(value) OVER (PARTITION BY channel ORDER BY idx) AS f FROM g), s AS (SELECT *, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi, MIN(f) OVER w AS flo, MAX(f) OVER w AS fhi FROM r WHERE f IS NOT NULL WINDOW w AS (PARTITION BY channel)),
b AS (SELECT channel, idx, LEAST(7, GREATEST(0, ceil((value - lo) / ((hi - lo) / 8)) - 1))::INT AS nw, LEAST(7, GREATEST(0, ceil((f - flo) / ((fhi - flo) / 8)) - 1))::INT AS nx FROM s),
n AS (SELECT x.channel AS cx, y.channel AS cy, y.nx AS a, y.nw AS b, x.nw AS c, COUNT(*)::DOUBLE AS n FROM b x JOIN b y ON x.idx = y.idx AND x.channel <> y.channel GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT cx, cy, n, log2(n * SUM(n) OVER (PARTITION BY cx, cy, b) / (SUM(n) OVER (PARTITION BY cx, cy, a, b) * SUM(n) OVER (PARTITION BY cx, cy, b, c))) AS l, SUM(n) OVER (PARTITION BY cx, cy) AS tot FROM n),
e AS (SELECT cx, cy, SUM(n * l) / MAX(tot) AS te FROM t GROUP BY cx, cy)
SELECT x.cx AS channel_x, x.cy AS channel_y, {rd('x.te')} AS te_xy, {rd('y.te')} AS te_yx, {rd('x.te - y.te')} AS net_te FROM e x JOIN e y ON y.cx = x.cy AND y.cy = x.cx WHERE x.cx < x.cy""")
def te_histogram(spark, sf_dir):
    return directed.te_histogram(hourly(spark, sf_dir)).drop("recording")


@query(f"""WITH {G}, e AS (SELECT * FROM (SELECT channel, idx AS t, value AS p, lead(value) OVER (PARTITION BY channel ORDER BY idx) AS f FROM g) WHERE f IS NOT NULL),
d AS MATERIALIZED (SELECT x.channel AS cx, y.channel AS cy, y.t, y.f, y.p, x.p AS s FROM e x JOIN e y ON x.t = y.t AND x.channel <> y.channel),
q AS MATERIALIZED (SELECT a.cx, a.cy, a.t, min(GREATEST(abs(a.f - b.f), abs(a.p - b.p), abs(a.s - b.s)), 5)[5] AS eps FROM d a JOIN d b ON a.cx = b.cx AND a.cy = b.cy GROUP BY a.cx, a.cy, a.t),
c AS MATERIALIZED (SELECT a.cx, a.cy, a.t, COUNT(*) FILTER (abs(a.p - b.p) < eps) AS n1, COUNT(*) FILTER (GREATEST(abs(a.p - b.p), abs(a.f - b.f)) < eps) AS n2, COUNT(*) FILTER (GREATEST(abs(a.p - b.p), abs(a.s - b.s)) < eps) AS n3
  FROM (SELECT d.*, eps FROM d JOIN q USING (cx, cy, t)) a JOIN d b ON a.cx = b.cx AND a.cy = b.cy GROUP BY a.cx, a.cy, a.t),
h AS (SELECT n, COALESCE(SUM(1.0e0 / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329e0 AS psi FROM (SELECT range AS n FROM range(1, 1000))),
z AS (SELECT cx, cy, (SELECT psi FROM h WHERE n = 4) + AVG(h1.psi - h2.psi - h3.psi) AS te FROM c JOIN h h1 ON h1.n = GREATEST(1, n1) JOIN h h2 ON h2.n = GREATEST(1, n2) JOIN h h3 ON h3.n = GREATEST(1, n3) GROUP BY cx, cy)
SELECT x.cx AS channel_x, x.cy AS channel_y, {rd('x.te')} AS te_xy, {rd('y.te')} AS te_yx, {rd('x.te - y.te')} AS net_te FROM z x JOIN z y ON y.cx = x.cy AND y.cy = x.cx WHERE x.cx < x.cy""")
def te_ksg(spark, sf_dir):
    return directed.transfer_entropy(hourly(spark, sf_dir)).drop("recording")


@query()
def te_effective(spark, sf_dir):
    return directed.transfer_entropy(hourly(spark, sf_dir), estimator="histogram", effective=True).drop("recording")


# ---- time-frequency --------------------------------------------------------


def morlet_sql(frequencies: list[float], smoothing: float | None) -> str:
    """wt: wavelet transforms of the 720 samples padded to 2048; wp: products of pairs; wm: these smoothed, mirrored at the ends."""
    values = ", ".join(f"({f}e0)" for f in frequencies)
    turn = "2 * pi() * ((k * {i}) % 2048) / 2048"
    out = f"""{G}, fq AS (SELECT f FROM (VALUES {values}) t(f)),
wf AS (SELECT channel, k.range AS k, SUM(value * cos(2 * pi() * ((k.range * idx) % 2048) / 2048)) AS a, -SUM(value * sin(2 * pi() * ((k.range * idx) % 2048) / 2048)) AS b FROM g CROSS JOIN range(1025) k GROUP BY channel, k.range),
wg AS (SELECT f, k.range AS k, exp(-0.5e0 * pow((k.range * 24 / 2048.0e0 - f) / (f / 7), 2)) AS e FROM fq CROSS JOIN range(1025) k),
wt AS (SELECT channel, f, i.range AS i, SUM(e * (a * cos({turn.format(i='i.range')}) - b * sin({turn.format(i='i.range')}))) / 2048 AS re, SUM(e * (a * sin({turn.format(i='i.range')}) + b * cos({turn.format(i='i.range')}))) / 2048 AS im
  FROM wf JOIN wg USING (k) CROSS JOIN range(720) i WHERE e > 1e-18 GROUP BY channel, f, i.range),
wp AS (SELECT x.channel AS channel_x, y.channel AS channel_y, f, i, x.re * y.re + x.im * y.im AS c, x.im * y.re - x.re * y.im AS s, x.re * x.re + x.im * x.im AS xx, y.re * y.re + y.im * y.im AS yy FROM wt x JOIN wt y USING (f, i) WHERE x.channel < y.channel)"""
    if smoothing is None:
        return out
    return out + f""",
wk AS (SELECT f, d, w / SUM(w) OVER (PARTITION BY f) AS w FROM (SELECT f, d.range AS d, exp(-0.5e0 * pow(d.range / ({smoothing} / f * 24), 2)) AS w FROM fq CROSS JOIN range(-360, 361) d WHERE abs(d.range) <= LEAST(ceil(3 * {smoothing} / f * 24), 360))),
wi AS (SELECT f, i.range AS i, CASE WHEN i.range + d < 0 THEN -1 - i.range - d WHEN i.range + d > 719 THEN 1439 - i.range - d ELSE i.range + d END AS j, w FROM wk CROSS JOIN range(720) i),
wm AS (SELECT channel_x, channel_y, wi.f, wi.i, SUM(w * c) AS c, SUM(w * s) AS s, SUM(w * xx) AS xx, SUM(w * yy) AS yy, SUM(w * c / sqrt(c * c + s * s)) AS uc, SUM(w * s / sqrt(c * c + s * s)) AS us FROM wi JOIN wp ON wp.f = wi.f AND wp.i = wi.j GROUP BY channel_x, channel_y, wi.f, wi.i)"""


@query(f"WITH {morlet_sql([0.5, 1, 2, 4], 3)} SELECT channel_x, channel_y, {rd('f')} AS frequency, {rd('AVG(LEAST(1, CASE WHEN xx * yy <= 2.220446049250313e-16 THEN 0 ELSE (c * c + s * s) / (xx * yy) END))')} AS coherence, COUNT(*) AS n FROM wm GROUP BY channel_x, channel_y, f")
def wavelet_coherence(spark, sf_dir):
    return wavelet.wavelet_coherence(hourly(spark, sf_dir), SR, [0.5, 1, 2, 4]).groupBy("channel_x", "channel_y", "frequency").agg(F.avg("coherence").alias("coherence"), F.count("*").alias("n"))


@query(f"WITH {morlet_sql([0.5, 1, 2, 4], 3)} SELECT channel_x, channel_y, {rd('f')} AS frequency, {rd('AVG(LEAST(1, sqrt(uc * uc + us * us)))')} AS plv, COUNT(*) AS n FROM wm GROUP BY channel_x, channel_y, f")
def wavelet_plv(spark, sf_dir):
    return wavelet.wavelet_plv(hourly(spark, sf_dir), SR, [0.5, 1, 2, 4]).groupBy("channel_x", "channel_y", "frequency").agg(F.avg("plv").alias("plv"), F.count("*").alias("n"))


@query(f"WITH {morlet_sql([0.5, 2], None)} SELECT channel_x, channel_y, {rd('f')} AS frequency, i AS idx, {rd('(i + 1) / 24.0e0')} AS time, {rd('c')} AS re, {rd('s')} AS im, {rd('sqrt(c * c + s * s)')} AS power, {rd('sqrt(2.0e0) * 7 / (2 * pi() * GREATEST(LEAST(i, 719 - i) / 24.0e0, 1 / 24.0e0))')} AS coi FROM wp")
def xwt_values(spark, sf_dir):
    """Every value of two frequencies; the significance level of `xwt` rests on drawn noise."""
    return wavelet.cross_wavelet(hourly(spark, sf_dir), SR, [0.5, 2], n_surrogates=0).drop("recording", "phase")


@query()
def xwt(spark, sf_dir):
    return wavelet.cross_wavelet(hourly(spark, sf_dir), SR, [0.5, 1, 2]).groupBy("channel_x", "channel_y", "frequency").agg(F.avg(F.col("significant").cast("double")).alias("share"), F.max("level").alias("level"))


@query(f"WITH {G} SELECT x.channel || '-' || y.channel AS pair, 1440::BIGINT AS n, {rd('2.0e0')} AS coi FROM (SELECT DISTINCT channel FROM g) x JOIN (SELECT DISTINCT channel FROM g) y ON x.channel < y.channel")
def wavelet_coherence_frame(spark, sf_dir):
    return plots.wavelet_coherence_frame(wavelet.wavelet_coherence(hourly(spark, sf_dir), SR, [1, 2])).groupBy("pair").agg(F.count("*").alias("n"), F.max("coi").alias("coi"))


# ---- dispatch --------------------------------------------------------------


@query(f"WITH {SEGS} SELECT channel_x, channel_y, {rd('MAX(LEAST(1.0e0, (re * re + im * im) / (xx * yy)))')} AS value FROM p GROUP BY channel_x, channel_y")
def coupling_matrix_coherence(spark, sf_dir):
    return registry.coupling_matrix(hourly(spark, sf_dir), SR, "coherence", nperseg=SEG).drop("recording")


@query(f"WITH {ZP} SELECT channel_x AS \"row\", channel_y AS \"column\", {rd('sqrt(mc * mc + ms * ms)')} AS value FROM m")
def coupling_matrix_plv(spark, sf_dir):
    return plots.coupling_matrix_frame(registry.coupling_matrix(hourly(spark, sf_dir), SR, "plv", band=BAND, kind="fft"))


@query(f"WITH {CCF} SELECT channel_x, channel_y, lag::INT AS lag, {rd('lag / 24.0e0')} AS lag_sec, {rd('correlation')} AS correlation, true AS hit FROM r WHERE lag BETWEEN -5 AND 5")
def coupling_cached(spark, sf_dir):
    s = SignalSet.of(hourly(spark, sf_dir), {"events": SR})
    first, s, _ = registry.coupling_analysis_cached(s, "events", SR, "crosscorrelation", max_lag=5)
    again, _, hit = registry.coupling_analysis_cached(s, "events", SR, "crosscorrelation", max_lag=5)
    return again.withColumn("hit", F.lit(hit)).drop("recording")


# ---- resampling inference --------------------------------------------------


def _shifts(spark):
    return spark.range(99).select(F.col("id").alias("rep"), (F.col("id") * 7 + 3).alias("shift"))


@query(f"""WITH {G}, o AS (SELECT x.channel AS channel_x, y.channel AS channel_y, abs(corr(x.value, y.value)) AS obs FROM g x JOIN g y ON x.idx = y.idx AND x.channel < y.channel GROUP BY 1, 2),
n AS (SELECT x.channel AS channel_x, y.channel AS channel_y, r.range AS rep, abs(corr(x.value, y.value)) AS s FROM range(99) r CROSS JOIN g y JOIN g x ON x.idx = ((y.idx - (r.range * 7 + 3)) % 720 + 720) % 720 AND x.channel < y.channel GROUP BY 1, 2, 3)
SELECT channel_x, channel_y, {rd('MAX(obs)')} AS observed, {rd('(SUM((s >= obs)::INT) + 1) / 100.0e0')} AS p_value, {rd('quantile_cont(s, 0.95)')} AS threshold_95 FROM n JOIN o USING (channel_x, channel_y) GROUP BY channel_x, channel_y""")
def surrogate_timeshift_p(spark, sf_dir):
    """Absolute correlation against 99 given circular shifts of y, for all pairs at once."""
    g = hourly(spark, sf_dir).drop("recording")
    moved = inference.shifted(g, _shifts(spark), N).select("rep", F.col("channel").alias("channel_y"), "idx", F.col("value").alias("vy"))
    moved = moved.unionByName(g.select(F.lit(-1).cast("long").alias("rep"), F.col("channel").alias("channel_y"), "idx", F.col("value").alias("vy")))
    both = g.select(F.col("channel").alias("channel_x"), "idx", F.col("value").alias("vx")).join(moved, "idx").where("channel_x < channel_y")
    stats = both.groupBy("channel_x", "channel_y", "rep").agg(F.abs(F.corr("vx", "vy")).alias("stat"))
    return inference.surrogate_summary(stats, ["channel_x", "channel_y"]).select("channel_x", "channel_y", "observed", "p_value", "threshold_95")


@query(f"""WITH {G}, s AS (SELECT r.range AS rep, k.range AS k, (r.range * 31 + k.range * 97) % 693 AS start FROM range(60) r CROSS JOIN range(27) k), a AS (SELECT rep, k * 27 + j.range AS pos, start + j.range AS idx FROM s CROSS JOIN range(27) j WHERE k * 27 + j.range < 720),
b AS (SELECT a.rep, corr(x.value, y.value) AS s FROM a JOIN g x ON x.idx = a.idx AND x.channel = 'click' JOIN g y ON y.idx = a.idx AND y.channel = 'view' GROUP BY a.rep)
SELECT {rd('quantile_cont(s, 0.025)')} AS lower, {rd('quantile_cont(s, 0.975)')} AS upper FROM b""")
def block_bootstrap_ci(spark, sf_dir):
    """Percentile interval of a correlation over given block starts (27 blocks of 27)."""
    x, y = _xy(spark, sf_dir)
    pair = x.select("idx", F.col("value").alias("vx")).join(y.select("idx", F.col("value").alias("vy")), "idx")
    starts = spark.range(60).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long"))).alias("k")).withColumn("start", (F.col("rep") * 31 + F.col("k") * 97) % 693)
    stats = inference.boot_rows(pair, starts, 27, N).groupBy("rep").agg(F.corr("vx", "vy").alias("s"))
    return stats.agg(F.percentile("s", 0.025).alias("lower"), F.percentile("s", 0.975).alias("upper"))


@query()
def surrogate_matrix(spark, sf_dir):
    return inference.surrogate_matrix_test(hourly(spark, sf_dir), registry.statistic("coherence", SR, nperseg=SEG), surrogate="phase").drop("recording")


@query()
def surrogate_iaaft(spark, sf_dir):
    return inference.surrogate_test(hourly(spark, sf_dir), registry.statistic("crosscorrelation", SR, max_lag=10), surrogate="iaaft").drop("recording")


@query()
def bootstrap_plv(spark, sf_dir):
    return inference.bootstrap_ci(hourly(spark, sf_dir), registry.statistic("plv", SR, band=BAND, kind="fft")).drop("recording")


def _pvalues(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7919 % 10007 + 1) / 10008).alias("p"))


PV = "pv AS (SELECT c_custkey, c_nationkey, (c_custkey * 7919 % 10007 + 1) / 10008.0e0 AS p FROM customer), rk AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p) AS r, COUNT(*) OVER (PARTITION BY c_nationkey) AS m FROM pv)"


@query(f"WITH {PV} SELECT c_custkey, {rd('LEAST(1.0e0, MIN(p * m / r) OVER (PARTITION BY c_nationkey ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM rk")
def bh_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "BH").select("c_custkey", "p_adjusted")


@query(f"WITH {PV} SELECT c_custkey, {rd('LEAST(1.0e0, p * m)')} AS p_adjusted FROM rk")
def bonferroni_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "bonferroni").select("c_custkey", "p_adjusted")


@query(f"WITH {PV} SELECT c_custkey, {rd('LEAST(1.0e0, MAX(p * (m - r + 1)) OVER (PARTITION BY c_nationkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM rk")
def holm_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "holm").select("c_custkey", "p_adjusted")


@query(f"WITH {PV} SELECT c_custkey, {rd('LEAST(1.0e0, MIN(p * (m - r + 1)) OVER (PARTITION BY c_nationkey ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM rk")
def hochberg_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "hochberg").select("c_custkey", "p_adjusted")


@query(f"WITH {PV}, hs AS (SELECT c_nationkey, SUM(1.0e0 / r) AS q FROM rk GROUP BY 1) SELECT c_custkey, {rd('LEAST(1.0e0, MIN(q * p * m / r) OVER (PARTITION BY rk.c_nationkey ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM rk JOIN hs ON hs.c_nationkey = rk.c_nationkey")
def by_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "BY").select("c_custkey", "p_adjusted")


@query(f"""WITH {PV}, ms AS (SELECT DISTINCT c_nationkey, m AS n, k.k AS k FROM rk, unnest(range(LEAST(2, m), m + 1)) k(k)),
cm AS (SELECT ms.c_nationkey, ms.n, ms.k, MIN(ms.k * rk.p / (rk.r - (ms.n - ms.k))) AS c FROM ms JOIN rk ON rk.c_nationkey = ms.c_nationkey AND rk.r > ms.n - ms.k + CASE WHEN ms.k = ms.n THEN 0 ELSE 1 END GROUP BY 1, 2, 3),
q AS (SELECT i.c_custkey, i.p, CASE WHEN cm.k = cm.n THEN cm.c ELSE LEAST(cm.k * CASE WHEN i.r <= cm.n - cm.k + 1 THEN i.p ELSE b.p END, cm.c) END AS v
  FROM rk i JOIN cm ON cm.c_nationkey = i.c_nationkey JOIN rk b ON b.c_nationkey = cm.c_nationkey AND b.r = cm.n - cm.k + 1)
SELECT c_custkey, {rd('GREATEST(MAX(p), MAX(v))')} AS p_adjusted FROM q GROUP BY c_custkey""")
def hommel_adjust(spark, sf_dir):
    return inference.adjusted(_pvalues(spark, sf_dir), "p", ["c_nationkey"], "hommel").select("c_custkey", "p_adjusted")


# ---- fusion ----------------------------------------------------------------


def _blocks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    at = {"a": (1, 16), "b": (17, 16), "c": (33, 16), "d": (49, 16), "a1": (1, 2), "b1": (17, 2)}
    return e.select(F.col("vec_id").alias("obs_id"), *(F.slice("embedding", i, n).cast("array<double>").alias(k) for k, (i, n) in at.items()))


E2 = "e AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[17]::DOUBLE AS y1, embedding[18]::DOUBLE AS y2 FROM embeddings), "
CP = "covar_pop({0}, {1}) * COUNT(*)"


@query(
    "WITH " + E2[:-2] + ", s AS (SELECT COUNT(*) AS n, " + ", ".join(f"{CP.format(a, b)} AS {a}{b}" for a in ("x1", "x2", "y1", "y2") for b in ("x1", "x2", "y1", "y2"))
    + f" FROM e) SELECT {rd('(x1y1 * x1y1 + x1y2 * x1y2 + x2y1 * x2y1 + x2y2 * x2y2) / sqrt((x1x1 * x1x1 + 2 * x1x2 * x1x2 + x2x2 * x2x2) * (y1y1 * y1y1 + 2 * y1y2 * y1y2 + y2y2 * y2y2))')} AS rv, n FROM s"
)
def rv_coefficient(spark, sf_dir):
    return fusion.rv_coefficient(_blocks(spark, sf_dir), "a1", "b1")


DIST = E2 + "d AS (SELECT p.id AS i, q.id AS j, sqrt(pow(p.x1 - q.x1, 2) + pow(p.x2 - q.x2, 2)) AS a, sqrt(pow(p.y1 - q.y1, 2) + pow(p.y2 - q.y2, 2)) AS b FROM e p CROSS JOIN e q)"


@query(f"""WITH {DIST}, c AS (SELECT a - AVG(a) OVER (PARTITION BY i) - AVG(a) OVER (PARTITION BY j) + AVG(a) OVER () AS a, b - AVG(b) OVER (PARTITION BY i) - AVG(b) OVER (PARTITION BY j) + AVG(b) OVER () AS b FROM d)
SELECT {rd('sqrt(AVG(a * b)) / sqrt(sqrt(AVG(a * a)) * sqrt(AVG(b * b)))')} AS dcor, {rd('sqrt(AVG(a * b))')} AS dcov, sqrt(COUNT(*))::BIGINT AS n FROM c""")
def distance_correlation(spark, sf_dir):
    return fusion.distance_correlation(_blocks(spark, sf_dir), "a1", "b1")


@query(f"WITH {DIST} SELECT 'a1' AS block_x, 'b1' AS block_y, {rd('corr(a, b)')} AS similarity FROM d WHERE i > j")
def rsa_pearson(spark, sf_dir):
    return fusion.representational_similarity(_blocks(spark, sf_dir), ["a1", "b1"], compare="pearson")


@query(f"""WITH {DIST}, w AS (SELECT rank() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0e0 AS b FROM d WHERE i > j)
SELECT 'a' AS block_x, 'b' AS block_y, {rd('corr(a, b)')} AS similarity FROM w""".replace("'a' AS", "'a1' AS").replace("'b' AS", "'b1' AS"))
def rsa_spearman(spark, sf_dir):
    return fusion.representational_similarity(_blocks(spark, sf_dir), ["a1", "b1"])


@query(f"WITH {E2[:-2]} SELECT id AS obs_id, {rd('(x1 - AVG(x1) OVER ()) / stddev_samp(x1) OVER ()')} AS f1, {rd('(x2 - AVG(x2) OVER ()) / stddev_samp(x2) OVER ()')} AS f2, {rd('(y1 - AVG(y1) OVER ()) / stddev_samp(y1) OVER ()')} AS f3, {rd('(y2 - AVG(y2) OVER ()) / stddev_samp(y2) OVER ()')} AS f4 FROM e")
def fuse_zscore(spark, sf_dir):
    rows, _ = fusion.fuse_blocks(_blocks(spark, sf_dir), ["a1", "b1"])
    return rows.select("obs_id", *(F.get("fused", F.lit(k)).alias(f"f{k + 1}") for k in range(4)))


@query(f"WITH {E2}f AS (SELECT *, sqrt((var_pop(x1) OVER () + var_pop(x2) OVER ()) * COUNT(*) OVER ()) AS fx, sqrt((var_pop(y1) OVER () + var_pop(y2) OVER ()) * COUNT(*) OVER ()) AS fy FROM e) SELECT id AS obs_id, {rd('(x1 - AVG(x1) OVER ()) / fx')} AS f1, {rd('(x2 - AVG(x2) OVER ()) / fx')} AS f2, {rd('(y1 - AVG(y1) OVER ()) / fy')} AS f3, {rd('(y2 - AVG(y2) OVER ()) / fy')} AS f4 FROM f")
def fuse_frobenius(spark, sf_dir):
    rows, _ = fusion.fuse_blocks(_blocks(spark, sf_dir), ["a1", "b1"], method="frobenius")
    return rows.select("obs_id", *(F.get("fused", F.lit(k)).alias(f"f{k + 1}") for k in range(4)))


@query()
def fuse_mfa(spark, sf_dir):
    return fusion.fuse_blocks(_blocks(spark, sf_dir), ["a", "b"], method="mfa")[0].select("obs_id", F.get("fused", F.lit(0)).alias("f1"))


@query(f"WITH s AS (SELECT AVG(embedding[1]::DOUBLE) AS m, stddev_samp(embedding[1]::DOUBLE) AS d FROM embeddings), l AS (SELECT vec_id AS id, abs(embedding[1]::DOUBLE - m) / d AS dist FROM embeddings, s), t AS (SELECT AVG(ln(dist + 1e-9)) AS m, stddev_samp(ln(dist + 1e-9)) AS d FROM l) SELECT id, {rd('100 - 10 * (ln(dist + 1e-9) - t.m) / t.d')} AS index, {rd('dist')} AS distance FROM l, t")
def deviation_index_1d(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("obs_id"), F.slice("embedding", 1, 1).alias("f"))
    return fusion.deviation_index(e, e, "f").select("id", "index", "distance")


@query()
def deviation_index(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return fusion.deviation_index(b, b, "a", {"low": (0, 8), "high": (8, 16)})


@query()
def jive(spark, sf_dir):
    return fusion.jive(_blocks(spark, sf_dir), ["a", "b", "c", "d"])[1]


@query()
def mfa(spark, sf_dir):
    return fusion.multiple_factor_analysis(_blocks(spark, sf_dir), ["a", "b", "c", "d"])[1].select("factor", "eigenvalue", "explained")


@query()
def cca(spark, sf_dir):
    return fusion.cca(_blocks(spark, sf_dir), "a", "b")[1]


@query("WITH s AS (SELECT abs(corr(embedding[1]::DOUBLE, embedding[17]::DOUBLE)) AS c FROM embeddings) SELECT 1 AS pair, " + rd("c") + " AS cor FROM s")
def cca_1d(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("obs_id", F.slice("a", 1, 1).alias("a"), F.slice("b", 1, 1).alias("b"))
    return fusion.cca(b, "a", "b")[1]


@query()
def pls(spark, sf_dir):
    return fusion.pls_blocks(_blocks(spark, sf_dir), "a", "b")[1]


@query()
def coupled_nmf(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    pos = b.select("obs_id", F.transform("a", lambda v: F.abs(v)).alias("a"), F.transform("b", lambda v: F.abs(v)).alias("b"))
    return fusion.coupled_nmf(pos, "a", "b", 2).select("restart", "vaf", "iterations")


@query()
def crossblock_factor(spark, sf_dir):
    return fusion.cross_block_factor(_blocks(spark, sf_dir), ["a", "b"], 2)[1]


# ---- cross-site benchmark --------------------------------------------------


def _orders(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "o_totalprice", "c_acctbal", "o_orderstatus")


LO = "o AS (SELECT n_regionkey::VARCHAR AS site, o_totalprice AS y, c_acctbal AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), "


@query(f"""WITH {LO}st AS (SELECT DISTINCT site FROM o), f AS (SELECT st.site, regr_slope(o.y, o.x) AS b, regr_intercept(o.y, o.x) AS a, COUNT(*) AS n FROM st JOIN o ON o.site <> st.site GROUP BY st.site),
r AS (SELECT o.site, f.n, y, f.a + f.b * x AS p FROM o JOIN f ON f.site = o.site)
SELECT site, MAX(n) AS n_train, COUNT(*) AS n_test, 'ok' AS status, ROUND(sqrt(AVG((y - p) * (y - p))), 4) + 0.0 AS rmse, ROUND(AVG(abs(y - p)), 4) + 0.0 AS mae, {rd('pow(corr(y, p), 2)')} AS r2 FROM r GROUP BY site""")
def lodo_gaussian(spark, sf_dir):
    out = lodo.lodo(_orders(spark, sf_dir), "o_totalprice", "n_regionkey", ["c_acctbal"])
    return out.withColumn("rmse", F.round("rmse", 4)).withColumn("mae", F.round("mae", 4))


@query(f"""WITH {LO}l AS (SELECT site, x, (o_s = 'F')::INT AS pos FROM (SELECT n_regionkey::VARCHAR AS site, c_acctbal AS x, o_orderstatus AS o_s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)),
c AS (SELECT site, x, SUM(pos) AS p, SUM(1 - pos) AS q FROM l GROUP BY 1, 2), w AS (SELECT *, COALESCE(SUM(q) OVER (PARTITION BY site ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT site, {rd('SUM(p * (below + q / 2.0e0)) / (SUM(p) * SUM(q))')} AS auc FROM w GROUP BY site""")
def lodo_auc(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("n_regionkey").cast("string").alias("site"), F.col("c_acctbal").alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return lodo.auc(rows, ["site"])


@query()
def lodo_binomial(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return lodo.lodo(t("labels").join(t("documents"), "doc_id"), "quality", "lang", ["n_chars"], "binomial", 1)


# ---- flat and short signals, two recordings --------------------------------

GZ = grid_sql(name="g0") + ", g AS (SELECT channel, idx, value FROM g0 UNION ALL SELECT 'zero', i.range, 0.0e0 FROM range(720) i)"


def _with_zero(spark, sf_dir):
    """The hourly channels and one that is zero throughout."""
    g = hourly(spark, sf_dir)
    zero = spark.range(N).select(*(F.lit("zero").alias(c) if c == "channel" else F.col("id").alias(c) if c == "idx" else F.lit(0.0).alias(c) if c == "value" else F.lit(None).cast(g.schema[c].dataType).alias(c) for c in g.columns))
    return g.unionByName(zero).withColumn("recording", F.lit("events"))


@query(f"""WITH {SEGS.replace(G, GZ)} SELECT channel_x, channel_y, bin::INT AS bin, {rd('bin * 12.0e0 / 32')} AS frequency,
CASE WHEN xx * yy > 0 THEN {rd('LEAST(1.0e0, (re * re + im * im) / (xx * yy))')} END AS coherence, {rd('1 - pow(0.05e0, 1.0e0 / (n - 1))')} AS confidence FROM p""")
def coherence_flat(spark, sf_dir):
    """Coherence beside a dead channel: null for its pairs."""
    return spectral.coherence(_with_zero(spark, sf_dir), SR, SEG).drop("recording")


@query(f"""WITH {GZ}, {band_sql('z', 15, 60)}, h AS (SELECT channel, idx, CASE WHEN re * re + im * im > 0 THEN re / sqrt(re * re + im * im) ELSE 1 END AS c, CASE WHEN re * re + im * im > 0 THEN im / sqrt(re * re + im * im) ELSE 0 END AS s FROM z),
m AS (SELECT x.channel AS channel_x, y.channel AS channel_y, COUNT(*) AS n, AVG(x.c * y.c + x.s * y.s) AS mc, AVG(x.s * y.c - x.c * y.s) AS ms FROM h x JOIN h y ON x.idx = y.idx AND x.channel < y.channel GROUP BY 1, 2)
SELECT channel_x, channel_y, {rd('sqrt(mc * mc + ms * ms)')} AS plv, {rd('((mc * mc + ms * ms) * n * n - n) / (n * (n - 1.0e0))')} AS ppc FROM m""")
def plv_flat(spark, sf_dir):
    """Phase locking beside a dead channel, whose phase is 0."""
    return phase.synchrony(_with_zero(spark, sf_dir), SR, BAND, kind="fft").select("channel_x", "channel_y", "plv", "ppc")


@query(f"""WITH {G}, s AS (SELECT channel, idx AS m, value * (0.5e0 * (1 - cos(2 * pi() * idx / 39))) AS v FROM g WHERE idx < 40),
w AS (SELECT SUM(pow(0.5e0 * (1 - cos(2 * pi() * i.range / 39)), 2)) AS e FROM range(40) i),
f AS (SELECT channel, b.range AS bin, SUM(v * cos(2 * pi() * b.range * m / 40)) AS re, -SUM(v * sin(2 * pi() * b.range * m / 40)) AS im FROM s CROSS JOIN range(21) b GROUP BY channel, b.range)
SELECT channel, bin::INT AS bin, {rd('bin * 12.0e0 / 20')} AS frequency, {rd('(re * re + im * im) * CASE WHEN bin IN (0, 20) THEN 1 ELSE 2 END / (24 * e)')} AS psd FROM f, w""")
def welch_short(spark, sf_dir):
    """Spectra of signals shorter than a segment: one segment of their own length."""
    return spectral.welch_psd(hourly(spark, sf_dir).where("idx < 40"), SR, SEG).drop("recording")


#: Hourly channels as x and half-hourly ones as y, these through the ideal low-pass at 0.9 of half the hourly rate and linear in time to the hourly grid.
TWO = f"""{grid_sql(60, 'g0')}, {grid_sql(30, 'h')},
hf AS (SELECT channel, k.range AS k, SUM(value * cos(2 * pi() * ((k.range * idx) % 1440) / 1440)) AS a, -SUM(value * sin(2 * pi() * ((k.range * idx) % 1440) / 1440)) AS b FROM h CROSS JOIN range(325) k GROUP BY channel, k.range),
hl AS (SELECT channel, i.range AS idx, SUM(CASE WHEN k = 0 THEN a ELSE 2 * (a * cos(2 * pi() * ((k * i.range) % 1440) / 1440) - b * sin(2 * pi() * ((k * i.range) % 1440) / 1440)) END) / 1440 AS value FROM hf CROSS JOIN range(1440) i GROUP BY channel, i.range),
tt AS (SELECT j.range AS j, LEAST(floor(j.range * 1439.0e0 / 720), 1438)::BIGINT AS k, j.range * 1439.0e0 / 720 - LEAST(floor(j.range * 1439.0e0 / 720), 1438) AS w FROM range(720) j),
hr AS (SELECT p.channel, tt.j AS idx, p.value * (1 - tt.w) + q.value * tt.w AS value FROM tt JOIN hl p ON p.idx = tt.k JOIN hl q ON q.idx = tt.k + 1 AND q.channel = p.channel),
g AS (SELECT 'x:' || channel AS channel, idx, value FROM g0 UNION ALL SELECT 'y:' || channel, idx, value FROM hr)"""
ACROSS = "WHERE channel_x LIKE 'x:%' AND channel_y LIKE 'y:%'"


def _between(spark, sf_dir, name, **args):
    return registry.coupling_between(two_rates(spark, sf_dir), "hourly", "half", name, match="fft", **args).drop("recording")


@query(f"""WITH {SEGS.replace(G, TWO)} SELECT channel_x[3:] AS channel_x, channel_y[3:] AS channel_y, bin::INT AS bin, {rd('bin * 12.0e0 / 32')} AS frequency,
{rd('LEAST(1.0e0, (re * re + im * im) / (xx * yy))')} AS coherence, {rd('1 - pow(0.05e0, 1.0e0 / (n - 1))')} AS confidence FROM p {ACROSS}""")
def couple_two_rates(spark, sf_dir):
    """Coherence of every hourly channel with every half-hourly one."""
    return _between(spark, sf_dir, "coherence", nperseg=SEG)


@query(f"WITH {ZP.replace(G, TWO)} SELECT channel_x[3:] AS channel_x, channel_y[3:] AS channel_y, n, {rd('sqrt(mc * mc + ms * ms)')} AS plv FROM m {ACROSS}")
def couple_two_rates_plv(spark, sf_dir):
    return _between(spark, sf_dir, "plv", band=BAND, kind="fft")


@query(f"WITH {CCF.replace(G, TWO)} SELECT channel_x[3:] AS channel_x, channel_y[3:] AS channel_y, lag::INT AS lag, {rd('lag / 24.0e0')} AS lag_sec, {rd('correlation')} AS correlation FROM r {ACROSS}")
def couple_two_rates_correlation(spark, sf_dir):
    return _between(spark, sf_dir, "crosscorrelation", max_lag=30)


@query(f"WITH {ZP.replace(G, TWO)} SELECT channel_x[3:] AS channel_x, channel_y[3:] AS channel_y, {rd('sqrt(mc * mc + ms * ms)')} AS value FROM m {ACROSS}")
def coupling_matrix_between(spark, sf_dir):
    return registry.coupling_matrix_between(two_rates(spark, sf_dir), "hourly", "half", "plv", match="fft", band=BAND, kind="fft").drop("recording")


@query(f"""WITH {E2[:-2]}, c AS (SELECT x1 - AVG(x1) OVER () AS x1, x2 - AVG(x2) OVER () AS x2, y1 - AVG(y1) OVER () AS y1, y2 - AVG(y2) OVER () AS y2 FROM e),
s AS (SELECT SUM(x1 * y1) AS a, SUM(x1 * y2) AS b, SUM(x2 * y1) AS c, SUM(x2 * y2) AS d, SUM(x1 * x1) AS xx, SUM(x1 * x2) AS xz, SUM(x2 * x2) AS zz, SUM(y1 * y1) AS yy, SUM(y1 * y2) AS yw, SUM(y2 * y2) AS ww FROM c)
SELECT {rd('(a * a + b * b + c * c + d * d) / sqrt((xx * xx + 2 * xz * xz + zz * zz) * (yy * yy + 2 * yw * yw + ww * ww))')} AS statistic FROM s""")
def association_statistic(spark, sf_dir):
    """The observed statistic of the permutation test; its p-value is in association_rv_p."""
    return fusion.association_p(_blocks(spark, sf_dir), "a1", "b1", "rv", permutations=1).select("statistic")


@query()
def association_rv_p(spark, sf_dir):
    return fusion.association_p(_blocks(spark, sf_dir), "a", "b", "rv")


@query(f"""WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type AS c, value AS v FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT h, SUM(CASE WHEN c = 'click' THEN v ELSE 0 END) AS x, SUM(CASE WHEN c = 'view' THEN v ELSE 0 END) AS y FROM e GROUP BY h),
s AS (SELECT time_bucket(INTERVAL 12 HOUR, h, TIMESTAMP '1970-01-01') - k.k * INTERVAL 12 HOUR AS start, x, y FROM b, (VALUES (0), (1)) k(k))
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, COUNT(*) AS n, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN {rd('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))')} END AS correlation FROM s GROUP BY s.start""")
def sliding_spans(spark, sf_dir):
    """The streaming operator over a finished table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("channel"), "value")
    return sliding.sliding_correlation(events, "click", "view")[0].withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# ---- generators ------------------------------------------------------------


@query()
def make_coupled_signals(spark, sf_dir):
    return signals.coupled_signals(spark, 500, 1000).groupBy("channel").agg(F.count("*").alias("n"), F.max("idx").alias("last"))


@query()
def make_eeg_emg(spark, sf_dir):
    return signals.eeg_emg(spark).groupBy("recording", "channel").agg(F.count("*").alias("n"))


@query()
def make_directed_signals(spark, sf_dir):
    return timedom.correlation_peak(timedom.cross_correlation(signals.directed_signals(spark, 3000), 500, 50)).drop("recording")


from resonarium import long_queries  # noqa: E402, F401  registers its queries here too
