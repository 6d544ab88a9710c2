"""Queries of the operators for signals of any length, over the events' own range of time.

Registered beside those of queries.py, under the same rules: whole tables, and
doubles rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from resonarium.operators import fourier, fusion, permutations, phase, recursive
from resonarium.plans import sql, summaries
from resonarium.queries import SQL, STATES, _blocks, _states, query, rd
from resonarium.queries import hourly as _hourly
from resonarium.sources import signals
from resonarium.streaming import lagged

#: Hourly sums from the first event to the last: channel, idx, value; and their number.
OWN = """o_b AS (SELECT event_type AS channel, epoch_us(ts) // 3600000000 AS b, value FROM events WHERE ts IS NOT NULL),
o_n AS (SELECT MIN(b) AS first, MAX(b) - MIN(b) + 1 AS n FROM o_b),
o_v AS (SELECT channel, b - first AS idx, SUM(value) AS value FROM o_b, o_n GROUP BY channel, b - first),
o AS (SELECT c.channel, i.idx, COALESCE(v.value, 0.0e0) AS value FROM (SELECT DISTINCT channel FROM o_v) c CROSS JOIN (SELECT unnest(range(n)) AS idx FROM o_n) i LEFT JOIN o_v v ON v.channel = c.channel AND v.idx = i.idx)"""


def hourly(spark, sf_dir):
    return signals.own_grid(spark, sf_dir)


# ---- recursive filters -----------------------------------------------------


def _recursion(name: str, source: str) -> str:
    """A filter of four past values each, from rest, over rows (channel, i, v)."""
    return f"""{name} AS (SELECT channel, i, v * n0 AS y, v AS x1, 0.0e0 AS x2, 0.0e0 AS x3, 0.0e0 AS x4, v * n0 AS y1, 0.0e0 AS y2, 0.0e0 AS y3, 0.0e0 AS y4 FROM {source}, k WHERE i = 0
  UNION ALL SELECT s.channel, s.i, n0 * (s.v - 2 * x2 + x4) - d1 * y1 - d2 * y2 - d3 * y3 - d4 * y4, s.v, x1, x2, x3, n0 * (s.v - 2 * x2 + x4) - d1 * y1 - d2 * y2 - d3 * y3 - d4 * y4, y1, y2, y3
  FROM {name} r JOIN {source} s ON s.channel = r.channel AND s.i = r.i + 1, k)"""


#: Second-order prototype between 2 and 6 cycles a day, its band-pass expanded in powers of the delay by hand.
_SECOND = """w AS (SELECT tan(pi() * 2 / 24) AS u, tan(pi() * 6 / 24) AS v),
q AS (SELECT v - u AS bw, 1 + u * v AS a, 2 * (u * v - 1) AS b FROM w),
p AS (SELECT a * a + sqrt(2) * bw * a + bw * bw AS d0, 2 * a * b + sqrt(2) * bw * b AS d1, b * b + 2 * a * a - 2 * bw * bw AS d2, 2 * a * b - sqrt(2) * bw * b AS d3, a * a - sqrt(2) * bw * a + bw * bw AS d4, bw * bw AS n0 FROM q),
k AS (SELECT n0 / d0 AS n0, d1 / d0 AS d1, d2 / d0 AS d2, d3 / d0 AS d3, d4 / d0 AS d4 FROM p)"""


@query(f"""WITH RECURSIVE {OWN}, {_SECOND},
s AS (SELECT channel, idx AS i, value AS v FROM o UNION ALL SELECT c.channel, n + j, 0.0e0 FROM (SELECT DISTINCT channel FROM o) c, o_n, (SELECT unnest(range(10)) AS j)),
{_recursion('forth', 's')}, t AS (SELECT channel, n + 9 - i AS i, y AS v FROM forth, o_n), {_recursion('back', 't')}
SELECT channel, n + 9 - i AS idx, {rd('y')} AS value FROM back, o_n WHERE i >= 10""")
def bandpass_recursive(spark, sf_dir):
    return recursive.bandpass(hourly(spark, sf_dir), 24.0, (2.0, 6.0), order=2).select("channel", "idx", "value")


@query(f"""WITH RECURSIVE {OWN}, w AS (SELECT tan(pi() * 3 / 24) AS w), k AS (SELECT w / (1 + w) AS n0, (w - 1) / (w + 1) AS d1 FROM w),
s AS (SELECT channel, idx AS i, value AS v FROM o UNION ALL SELECT c.channel, n + j, 0.0e0 FROM (SELECT DISTINCT channel FROM o) c, o_n, (SELECT unnest(range(4)) AS j)),
forth AS (SELECT channel, i, v AS x, n0 * v AS y FROM s, k WHERE i = 0 UNION ALL SELECT s.channel, s.i, s.v, n0 * (s.v + x) - d1 * y FROM forth r JOIN s ON s.channel = r.channel AND s.i = r.i + 1, k),
t AS (SELECT channel, n + 3 - i AS i, y AS v FROM forth, o_n),
back AS (SELECT channel, i, v AS x, n0 * v AS y FROM t, k WHERE i = 0 UNION ALL SELECT t.channel, t.i, t.v, n0 * (t.v + x) - d1 * y FROM back r JOIN t ON t.channel = r.channel AND t.i = r.i + 1, k)
SELECT channel, n + 3 - i AS idx, {rd('y')} AS value FROM back, o_n WHERE i >= 4""")
def lowpass_recursive(spark, sf_dir):
    return recursive.lowpass(hourly(spark, sf_dir), 24.0, 3.0, order=1).select("channel", "idx", "value")


@query()
def bandpass_recursive_order4(spark, sf_dir):
    """The default order over samples of a minute."""
    return recursive.bandpass(signals.own_grid(spark, sf_dir, 1), 1440.0, (20.0, 60.0)).groupBy("channel").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd"), F.max("value").alias("most"))


# ---- transforms of whole signals -------------------------------------------

ANGLE = "2 * pi() * ((k * i) % n) / n"
#: Transform at every frequency from 0 to half the rate: channel, k, a, b.
DFT = f"""{OWN}, dft AS (SELECT channel, k, n, SUM(value * cos({ANGLE})) AS a, -SUM(value * sin({ANGLE})) AS b
  FROM (SELECT channel, idx AS i, value FROM o) CROSS JOIN (SELECT n, unnest(range(n // 2 + 1)) AS k FROM o_n) GROUP BY channel, k, n)"""


def _analytic(keep: str) -> str:
    gain = "CASE WHEN k = 0 OR 2 * k = n THEN 1.0e0 ELSE 2.0e0 END"
    return f"""SELECT channel, i AS idx, {rd(f'SUM({gain} * (a * cos({ANGLE}) - b * sin({ANGLE}))) / n')} AS re, {rd(f'SUM({gain} * (a * sin({ANGLE}) + b * cos({ANGLE}))) / n')} AS im
FROM dft CROSS JOIN (SELECT unnest(range(n)) AS i FROM o_n) WHERE {keep} GROUP BY channel, i, n"""


@query(f"WITH {DFT} {_analytic('TRUE')}")
def hilbert_long(spark, sf_dir):
    return fourier.hilbert(hourly(spark, sf_dir)).select("channel", "idx", "re", "im")


@query(f"WITH {DFT} {_analytic('k * 24.0e0 / n BETWEEN 2 AND 6')}")
def band_long(spark, sf_dir):
    return fourier.ideal_band(hourly(spark, sf_dir), 24.0, (2.0, 6.0), analytic=True).select("channel", "idx", "re", "im")


@query(f"WITH {DFT} SELECT channel, k, {rd('sqrt(a * a + b * b)')} AS amplitude FROM dft")
def surrogate_spectrum_long(spark, sf_dir):
    """Amplitudes of signals whose phases were drawn anew: those of the signals."""
    rows = fourier.spectrum(fourier.phase_randomized(hourly(spark, sf_dir), seed=7))
    n = F.max("k").over(Window.partitionBy("channel")) + 1
    return rows.withColumn("n", n).where(F.col("k") <= F.floor(F.col("n") / 2)).select("channel", "k", F.hypot("re", "im").alias("amplitude"))


# ---- permutations ----------------------------------------------------------


def _network_sql(replicates: int, seed: int) -> str:
    """e: rows numbered by id; pm: where row j goes in each replicate, by a Feistel network of eight rounds walked on until below n."""
    left, right = "(v >> b)", "(v & ((1 << b) - 1))"
    steps = []
    for r in range(8):
        key = f"((({seed * 1_000_003} + rep * 8 + {r + 1}) * 48271 % 2147483647) * 69621 % 2147483647)"
        steps.append(f"SELECT rep, j, b, n, r AS l, xor(l, ((((r + {key}) % 2147483647) * ((r + {key}) % 2147483647) % 2147483647) >> 5) & ((1 << b) - 1)) AS r FROM ")
    inner = f"(SELECT rep, j, b, n, {left} AS l, {right} AS r FROM {{source}})"
    for s in steps:
        inner = f"({s}{inner})"
    turn = lambda source: f"SELECT rep, j, b, n, (l << b) | r AS v FROM {inner.format(source=source)}"
    return f"""e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding[1:16], lambda z: z::DOUBLE) AS x, list_transform(embedding[17:32], lambda z: z::DOUBLE) AS y FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
z AS (SELECT COUNT(*) AS n, GREATEST(1, CEIL(LENGTH(LTRIM(bin(COUNT(*) - 1), '0')) / 2.0))::BIGINT AS b FROM e),
w AS ({turn(f'(SELECT rep, i AS j, i AS v, b, n FROM e, z, (SELECT unnest(range({replicates})) AS rep))')} UNION ALL {turn('(SELECT * FROM w WHERE v >= n)')}),
pm AS (SELECT rep, j, v AS i FROM w WHERE v < n UNION ALL SELECT -1, i, i FROM e)"""


@query(f"""WITH RECURSIVE {_network_sql(199, 3)},
xs AS (SELECT i, k, x[k + 1] - AVG(x[k + 1]) OVER (PARTITION BY k) AS v FROM e, (SELECT unnest(range(16)) AS k)), ys AS (SELECT i, k, y[k + 1] - AVG(y[k + 1]) OVER (PARTITION BY k) AS v FROM e, (SELECT unnest(range(16)) AS k)),
q AS (SELECT sqrt((SELECT SUM(s * s) FROM (SELECT SUM(a.v * b.v) AS s FROM xs a JOIN xs b ON a.i = b.i GROUP BY a.k, b.k)) * (SELECT SUM(s * s) FROM (SELECT SUM(a.v * b.v) AS s FROM ys a JOIN ys b ON a.i = b.i GROUP BY a.k, b.k))) AS q),
g AS (SELECT rep, xs.k AS a, ys.k AS b, SUM(xs.v * ys.v) AS s FROM pm JOIN xs ON xs.i = pm.i JOIN ys ON ys.i = pm.j GROUP BY rep, xs.k, ys.k)
SELECT rep::INT AS rep, {rd('SUM(s * s) / q')} AS rv FROM g, q GROUP BY rep, q""")
def association_rv_permuted(spark, sf_dir):
    """The coefficient of two blocks of 16 dimensions, as it is and with 199 given permutations."""
    return permutations.permuted_rv(_blocks(spark, sf_dir), "a", "b", seed=3)


#: Distances of the first three blocks of 16 dimensions: i, j, d0, d1, d2.
DISTANCES = """b AS (SELECT vec_id AS i, list_transform(embedding[1:16], lambda z: z::DOUBLE) AS x, list_transform(embedding[17:32], lambda z: z::DOUBLE) AS y, list_transform(embedding[33:48], lambda z: z::DOUBLE) AS z FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT p.i, q.i AS j, list_distance(p.x, q.x) AS d0, list_distance(p.y, q.y) AS d1, list_distance(p.z, q.z) AS d2 FROM b p, b q)"""


@query(f"""WITH {DISTANCES}, r AS (SELECT *, AVG(d0) OVER p AS r0, AVG(d1) OVER p AS r1, AVG(d0) OVER q AS c0, AVG(d1) OVER q AS c1, AVG(d0) OVER () AS m0, AVG(d1) OVER () AS m1 FROM d WINDOW p AS (PARTITION BY i), q AS (PARTITION BY j)),
c AS (SELECT i, d0 - r0 - c0 + m0 AS a, d1 - r1 - c1 + m1 AS b FROM r)
SELECT {rd('sqrt(AVG(a * b)) / sqrt(sqrt(AVG(a * a)) * sqrt(AVG(b * b)))')} AS dcor, {rd('sqrt(AVG(a * b))')} AS dcov, COUNT(DISTINCT i) AS n FROM c""")
def distance_correlation_blocks(spark, sf_dir):
    """Two whole blocks of 16 dimensions."""
    return fusion.distance_correlation(_blocks(spark, sf_dir), "a", "b")


@query(f"""WITH {DISTANCES}, k AS (SELECT corr(d0, d1) AS ab, corr(d0, d2) AS ac, corr(d1, d2) AS bc FROM d WHERE i > j)
SELECT 'a' AS block_x, 'b' AS block_y, {rd('ab')} AS similarity FROM k UNION ALL SELECT 'a', 'c', {rd('ac')} FROM k UNION ALL SELECT 'b', 'c', {rd('bc')} FROM k""")
def rsa_pearson_blocks(spark, sf_dir):
    """Three whole blocks of 16 dimensions."""
    return fusion.representational_similarity(_blocks(spark, sf_dir), ["a", "b", "c"], compare="pearson")


# ---- accounts of results ---------------------------------------------------


@query(f"""WITH {STATES}, h AS (SELECT channel, state, -SUM(p * log2(p)) AS h FROM tp GROUP BY 1, 2), o AS (SELECT channel, state, COUNT(*) / 720.0e0 AS o FROM st GROUP BY 1, 2),
e AS (SELECT o.channel, SUM(o.o * COALESCE(h.h, 0)) AS entropy FROM o LEFT JOIN h ON h.channel = o.channel AND h.state = o.state GROUP BY 1),
s AS (SELECT channel, COUNT(*) AS steps, COUNT(DISTINCT state) AS k, AVG((state <> nxt)::INT) AS r FROM nx WHERE nxt IS NOT NULL GROUP BY 1)
SELECT (row_number() OVER (ORDER BY channel) - 1)::INT AS position, channel || ': ' || steps || ' steps between ' || k || ' states, ' || printf('%.3f', r) || ' of them to another state, entropy ' || printf('%.3f', entropy) || ' bits' AS line FROM s JOIN e USING (channel)""")
def summary_leida(spark, sf_dir):
    s = _states(spark, sf_dir)
    return summaries.transitions(phase.leida_transitions(s, ["channel"]), phase.leida_summary(s, 24.0, ["channel"]), "channel")


@query(f"""WITH {DISTANCES}, k AS (SELECT corr(d0, d1) AS ab, corr(d0, d2) AS ac, corr(d1, d2) AS bc FROM d WHERE i > j)
SELECT 0 AS position, 'distances of a and b: ' || printf('%.3f', ab) || ' alike' AS line FROM k UNION ALL SELECT 1, 'distances of a and c: ' || printf('%.3f', ac) || ' alike' FROM k UNION ALL SELECT 2, 'distances of b and c: ' || printf('%.3f', bc) || ' alike' FROM k""")
def summary_similarity(spark, sf_dir):
    return summaries.similarity(fusion.representational_similarity(_blocks(spark, sf_dir), ["a", "b", "c"], compare="pearson"))


@query()
def summary_fusion(spark, sf_dir):
    """What each fusion of two blocks of 16 dimensions came to, one after the other."""
    b = _blocks(spark, sf_dir)
    told = [
        summaries.joint_and_individual(fusion.jive(b, ["a", "b"])[1]),
        summaries.factors(fusion.multiple_factor_analysis(b, ["a", "b"])[1]),
        summaries.canonical(fusion.cca(b, "a", "b", ncomp=3)[1]),
        summaries.components(fusion.pls_blocks(b, "a", "b")[1]),
        summaries.shared_factors(fusion.cross_block_factor(b, ["a", "b"], 2)[1]),
        summaries.fused(*fusion.fuse_blocks(b, ["a", "b"]), "zscore"),
        summaries.association(fusion.rv_coefficient(b, "a", "b"), "rv", "RV coefficient"),
        summaries.association(fusion.distance_correlation(b, "a", "b"), "dcor", "distance correlation"),
    ]
    out = None
    for k, t in enumerate(told):
        t = t.withColumn("position", F.col("position") + 10 * k)
        out = t if out is None else out.unionByName(t)
    return out


# ---- table functions of SQL ------------------------------------------------


def _view(spark, sf_dir) -> str:
    sql.register(spark)
    _hourly(spark, sf_dir).createOrReplaceTempView("hourly_samples")
    return sql.PAIRS.format(samples="hourly_samples")


@query(SQL["coherence_magnitude"])
def sql_coherence(spark, sf_dir):
    pairs = _view(spark, sf_dir)
    rows = spark.sql(f"SELECT * FROM coherence(24.0D, 64, TABLE({pairs}) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)")
    return rows.drop("recording")


@query(SQL["granger_order1"])
def sql_granger(spark, sf_dir):
    pairs = _view(spark, sf_dir)
    return spark.sql(f"SELECT channel_x, channel_y, gc_xy, gc_yx FROM granger(1, TABLE({pairs}) PARTITION BY (recording, channel_x, channel_y) ORDER BY idx)")


# ---- streams ---------------------------------------------------------------


@query(f"""WITH e AS (SELECT epoch_us(ts) // 3600000000 AS step, event_type = 'click' AS first, value FROM events WHERE event_type IN ('click', 'view') AND ts IS NOT NULL AND value IS NOT NULL),
w AS (SELECT DISTINCT unnest(range(CEIL((step - 23) / 12.0)::BIGINT, step // 12 + 1)) AS win FROM e),
v AS (SELECT step, SUM(CASE WHEN first THEN value ELSE 0 END) AS x, SUM(CASE WHEN first THEN 0 ELSE value END) AS y FROM e GROUP BY step),
g AS (SELECT win, t, COALESCE(x, 0) AS x, COALESCE(y, 0) AS y FROM (SELECT win, unnest(range(24)) AS t FROM w) LEFT JOIN v ON step = win * 12 + t),
p AS (SELECT a.win, l.lag, a.x, b.y FROM g a CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) l JOIN g b ON b.win = a.win AND b.t = a.t + l.lag)
SELECT win, lag::INT AS lag, COUNT(*)::INT AS n, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN {rd('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))')} END AS correlation FROM p GROUP BY win, lag""")
def stream_lagged(spark, sf_dir):
    """The stateful operator over a finished table, which gives what a stream of it does."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("channel"), "value")
    return lagged.lagged_correlation(events, "click", "view", 3600, 24, 12, 3)
